"""Surrogates for personal data: keyed, type-consistent replacements that keep entities apart.

Numbers, addresses and mail names are permuted by a keyed Feistel network over exactly the
values of their format, so different entities get different surrogates and one entity
always gets the same. Names are drawn by key from names of the same gender and script.
Surrogates that two entities share, or that are themselves an entity of the corpus, are
found by a join over the distinct entities and drawn again until none is left.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

KINDS = ("email", "ip", "card", "ssn", "phone", "iban", "ipv6", "given", "surname")
#: Redrawn entities up to which the list is sent to all tasks; beyond it, it is joined to the texts.
SENT_REDRAWN = 50_000
#: Draws after which collisions are an error, and draws from which on surrogates of names and mail grow longer.
MOST_DRAWS, GROWING = 30, 8

#: Titles by gender, and given names by script and gender.
TITLES = {
    "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Г-н"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Г-жа"),
    "n": ("Dr", "Prof"),
}
GIVEN = {
    ("latin", "m"): "Adam Albert Anton Bruno Carl Daniel David Edgar Emil Felix Hugo Jonas Karl Leo Lucas Marco Martin Max Nils Oscar Paul Pedro Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Ada Alba Anna Bella Carla Clara Diana Elena Emma Eva Flora Greta Ida Irene Julia Laura Lena Lisa Lucia Maria Marta Nora Olga Paula Rosa Sara Sofia Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Фёдор".split(),
    ("cyrillic", "f"): "Алла Анна Вера Галина Дарья Елена Зоя Инна Ксения Лидия Мария Нина Ольга Полина Софья Юлия".split(),
}
SYLLABLES = {"latin": ("bcdfghklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу")}

_TITLE = {t: g for g, names in TITLES.items() for t in names}
#: Genders of the listed given names.
_LISTED = {name: {g for (_, g), own in GIVEN.items() if name in own} for names in GIVEN.values() for name in names}
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)?"
_PATTERNS = (
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w])")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)", re.A)),
    ("card", re.compile(r"(?<![\w-])(?:[3-6]\d{3}(?:\d{9,12}|(?:[ -]\d{4}){3})|3[47]\d\d[ -]\d{6}[ -]\d{5})(?![\w-])", re.A)),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A)),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A)),
    ("ipv6", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{6,39}(?![\w:])", re.A)),
    ("phone", re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]\d{3,4}(?![\w-])|(?<![\w.+])\+[1-9]\d{7,14}(?![\w-])", re.A)),
)
_PERSON = re.compile(rf"\b({'|'.join(sorted(_TITLE, key=len, reverse=True))})\.?[ ]({_NAME})(?:[ ]({_NAME}))?")
_BARE = re.compile(rf"(?<![\w-]){_NAME}(?![\w-])")
_HINT = re.compile(r"[0-9@:]")


def _iban_check(iban: str) -> int:
    """What an account number leaves by 97; a right one leaves 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _holds(kind: str, value: str) -> bool:
    """Whether a match of a kind's pattern is one of its values."""
    if kind == "iban":
        return _iban_check(value.replace(" ", "")) == 1
    if kind == "ipv6":
        try:
            address = ipaddress.IPv6Address(value)
        except ValueError:
            return False
        return not (address.is_loopback or address.is_unspecified)
    return True


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of the entities of a text, leftmost first, without overlap.

    A name that the text gives with a title is found without it as well, as the same entity.
    """
    found = []
    if _HINT.search(text):
        for rank, (kind, pattern) in enumerate(_PATTERNS):
            if kind == "email" and "@" not in text:
                continue
            found += [(m.start(), rank, m.end(), kind, "") for m in pattern.finditer(text) if _holds(kind, m[0])]
    known: dict[str, tuple[str, str]] = {}
    persons = list(_PERSON.finditer(text))
    # A title that tells no gender leaves it to the text's other mentions of the name, and then to the lists of names.
    told: dict[str, set[str]] = {}
    for m in persons:
        if m[3] and _TITLE[m[1]] != "n":
            told.setdefault(m[2], set()).add(_TITLE[m[1]])
    for m in persons:
        gender = _TITLE[m[1]]
        if gender == "n" and m[3]:
            here = told.get(m[2]) or _LISTED.get(m[2], ())
            gender = next(iter(here)) if len(here) == 1 else gender
        parts = [(2, "given"), (3, "surname")] if m[3] else [(2, "surname")]
        found += [(m.start(g), len(KINDS), m.end(g), kind, gender) for g, kind in parts]
        for g, kind in parts:
            known.setdefault(m[g], (kind, gender))
    if known:
        found += [(m.start(), len(KINDS) + 1, m.end(), *known[m[0]]) for m in _BARE.finditer(text) if m[0] in known]
    out, end = [], 0
    for start, _, stop, kind, gender in sorted(found):
        if start >= end:
            out.append((start, stop, kind, gender))
            end = stop
    return out


def normal(kind: str, value: str, gender: str) -> str:
    """What makes two mentions the same entity: digits of a number, a name with gender, else lower case."""
    if kind == "phone":
        country = re.match(r"\+\d{1,3}(?=\D)", value)
        return f"{country[0] if country else ''}:{re.sub(r'[^0-9]', '', value[country.end() if country else 0 :])}"
    if kind in ("card", "ssn"):
        return re.sub(r"[^0-9]", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(value).exploded
    return f"{gender}:{value}" if kind == "given" else value if kind == "surname" else value.lower()


def _draw(key: bytes, *what) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, what)).encode(), key=key, digest_size=8).digest(), "big")


def permute(x: int, size: int, key: bytes, *tweak) -> int:
    """A keyed permutation of range(size): six Feistel rounds, walked until inside the range."""
    if size < 2:
        return x
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for i in range(6):
            left, right = right, left ^ (_draw(key, *tweak, i, right) & mask)
        x = (left << half) | right
        if x < size:
            return x


def _signs(text: str, key: bytes, *tweak) -> str:
    """Permute a text over all texts with digits, lower and upper case letters at the same places."""
    kinds = [(10, 48) if "0" <= c <= "9" else (26, 97) if "a" <= c <= "z" else (26, 65) if "A" <= c <= "Z" else None for c in text]
    x, size = 0, 1
    for c, k in zip(text, kinds, strict=True):
        if k:
            x, size = x * k[0] + ord(c) - k[1], size * k[0]
    x = permute(x, size, key, size, *tweak)
    out = []
    for c, k in zip(reversed(text), reversed(kinds), strict=True):
        if k:
            x, digit = divmod(x, k[0])
            c = chr(k[1] + digit)
        out.append(c)
    return "".join(reversed(out))


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _network(octets: str) -> str:
    a, b = map(int, octets.split(".")[:2])
    private = a == 10 or (a, b) == (192, 168) or a == 172 and 16 <= b < 32
    return "private" if private else "special" if a in (0, 127) or a >= 224 else "public"


def _script(name: str) -> str:
    return "cyrillic" if "Ѐ" <= name[0] <= "ӿ" else "latin"


@lru_cache(100_000)
def surrogate(kind: str, entity: str, draw: int, key: bytes) -> str:
    """The surrogate of a normalised entity, itself normalised, at the given draw."""
    if kind == "email":
        name, host = entity.rsplit("@", 1)
        *labels, top = host.split(".")
        more = "".join(str(_draw(key, kind, entity, draw, i) % 10) for i in range(max(0, draw - GROWING)))
        return f"{_signs(name, key, kind, draw)}{more}@{'.'.join(_signs(x, key, 'host', draw) for x in labels)}.{top}"
    if kind == "ip":
        x = 0
        for o in entity.split("."):
            x = x << 8 | int(o)
        while True:
            x = permute(x, 1 << 32, key, kind, draw)
            found = ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
            if _network(found) == _network(entity):
                return found
    if kind == "card":
        # The digits that name the kind of card stay.
        lead, found = entity[: 2 if len(entity) == 15 else 1], entity
        while True:
            found = lead + _signs(found[len(lead) :], key, kind, lead, draw)
            if _luhn(found) == _luhn(entity):
                return found
    if kind == "phone":
        country, number = entity.split(":")
        return f"{country}:{_signs(number, key, kind, country, draw)}"
    if kind == "ssn":
        return _signs(entity, key, kind, draw)
    if kind == "iban":
        own = _signs(entity[4:], key, kind, entity[:2], draw)
        return f"{entity[:2]}{98 - _iban_check(f'{entity[:2]}00{own}'):02d}{own}"
    if kind == "ipv6":
        # The first 16 bits say what kind of network it is, and stay.
        low = permute(int(ipaddress.IPv6Address(entity)) & ((1 << 112) - 1), 1 << 112, key, kind, entity[:4], draw)
        return ipaddress.IPv6Address(int(entity[:4], 16) << 112 | low).exploded
    if kind == "given":
        gender, name = entity.split(":")
        names = GIVEN[_script(name), gender] if gender != "n" else next((v for v in GIVEN.values() if name in v), GIVEN[_script(name), "m"])
        return f"{gender}:{names[_draw(key, kind, entity, draw) % len(names)]}" if draw < 3 else f"{gender}:{_made_name(name, key, draw, kind, entity)}"
    return _made_name(entity, key, draw, kind, entity)


def _made_name(like: str, key: bytes, draw: int, *what) -> str:
    """A name of syllables in the script of ``like``, capitalised alike and about as long, or longer after many draws."""
    consonants, vowels = SYLLABLES[_script(like)]
    parts = []
    for i, part in enumerate(like.split("-")):
        n = min(6, max(2, (len(part) + 1) // 2)) + max(0, draw - GROWING) // 2
        x = _draw(key, *what, draw, i)
        letters = []
        for _ in range(n):
            x, c = divmod(x, len(consonants))
            x, v = divmod(x, len(vowels))
            letters.append(consonants[c] + vowels[v])
        parts.append("".join(letters).capitalize())
    return "-".join(parts)


def _formatted(kind: str, value: str, found: str) -> str:
    """A normalised surrogate in the format of the mention that it replaces."""
    if kind == "phone":
        country, found = found.split(":")
        return country + _formatted("ssn", value[len(country) :], found)
    if kind in ("card", "ssn"):
        digits = iter(found)
        return "".join(next(digits) if "0" <= c <= "9" else c for c in value)
    if kind == "iban":
        signs = iter(found)
        return "".join(c if c == " " else next(signs) for c in value)
    if kind == "ipv6":
        address = found if len(value) == 39 else ipaddress.IPv6Address(found).compressed
        return address.upper() if value.upper() == value else address
    if kind == "email":
        # After many draws digits follow the name.
        name, more = value.rsplit("@", 1)[0], len(found) - len(value)
        like = f"{name}{'0' * more}{value[len(name) :]}"
        return "".join(f.upper() if c.isupper() else f for c, f in zip(like, found, strict=True))
    return found.split(":")[-1]


def _entities(batches):
    for batch in batches:
        seen = Counter()
        for text in batch.column(0).to_pylist():
            for start, end, kind, gender in find_entities(text or ""):
                seen[kind, normal(kind, text[start:end], gender)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([e for _, e in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["kind", "entity", "n"])


def _drawn(key: bytes):
    def run(batches):
        for batch in batches:
            found = [surrogate(k, e, d, key) for k, e, d in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.string())], ["kind", "entity", "draw", "surrogate"])

    return run


def surrogate_table(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per distinct entity of ``docs``: kind, entity, draw and surrogate, both normalised.

    No two entities of a kind share a surrogate, and no surrogate is an entity of that
    kind. Given names are made up from the fourth draw on; after GROWING draws names and mail grow
    longer, so that there always are more. Where the values of a number's format are
    used up there is no such table, and an error says so. Without entities there are no rows.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    entities = stage(texts.mapInArrow(_entities, "kind string, entity string, n long").groupBy("kind", "entity").agg(F.sum("n").alias("n")), "entities")
    shape = "kind string, entity string, draw int, surrogate string"
    # Staged rows come back in few files; draws are dealt to all cores again.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draw = lambda rows: rows.select("kind", "entity", "draw").repartition(tasks, "kind", "entity").mapInArrow(_drawn(key), shape)
    now = stage(draw(entities.withColumn("draw", F.lit(0))), "surrogates")
    for _ in range(MOST_DRAWS):
        real = entities.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        first = now.groupBy("kind", "surrogate").agg(F.min(F.struct("draw", "entity")).alias("first"), F.count(F.lit(1)).alias("n"))
        poor = first.join(real, ["kind", "surrogate"], "left").where("n > 1 or real").select("kind", "surrogate", F.when(F.col("real").isNull(), F.col("first.entity")).alias("stays"))
        marked = now.join(poor.withColumn("poor", F.lit(True)), ["kind", "surrogate"], "left")
        again = F.coalesce("poor", F.lit(False)) & ~F.col("entity").eqNullSafe(F.col("stays"))
        marked = stage(marked.select("kind", "entity", (F.col("draw") + again.cast("int")).alias("draw"), "surrogate", again.alias("again")), "surrogates")
        if not marked.where("again").limit(1).count():
            break
        now = stage(marked.where("not again").select("kind", "entity", "draw", "surrogate").union(draw(marked.where("again"))), "surrogates")
    else:
        raise ValueError(f"surrogates still collide after {MOST_DRAWS} draws: a format has too few values")
    return now


def _replace(text: str, key: bytes, redrawn) -> tuple[str, Counter]:
    parts, at, counts = [], 0, Counter()
    for start, end, kind, gender in find_entities(text):
        value = text[start:end]
        entity = normal(kind, value, gender)
        parts += [text[at:start], _formatted(kind, value, surrogate(kind, entity, redrawn.get((kind, entity), 0), key))]
        counts[kind] += 1
        at = end
    return "".join([*parts, text[at:]]) if parts else text, counts


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """Replace the personal data of every document.

    Returns doc_id, one count for each of KINDS, and the text with its surrogates, a row
    per row of ``docs`` (other columns are ignored; rows repeated in full are each
    replaced alike). Null texts stay null with counts of 0, empty ones stay empty. One entity has the same surrogate in all documents. Texts are not moved: a
    task computes first draws itself and is sent those entities that were drawn again;
    should these be very many, each text is joined with its own instead.
    """
    table = surrogate_table(docs, key)
    redrawn = table.where("draw > 0").select("kind", "entity", "draw")
    n = redrawn.count()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sent = {(r.kind, r.entity): r.draw for r in redrawn.collect()} if n <= SENT_REDRAWN else None
    if sent is None:
        own = rows.select("text", F.xxhash64("text").alias("text_hash")).mapInArrow(_mentions, "text_hash long, kind string, entity string").distinct()
        own = own.join(redrawn, ["kind", "entity"]).groupBy("text_hash").agg(F.collect_list(F.struct("kind", "entity", "draw")).alias("own"))
        rows = rows.withColumn("text_hash", F.xxhash64("text")).join(own, "text_hash", "left").select("doc_id", "text", "own")
    shared = docs.sparkSession.sparkContext.broadcast(sent)

    def run(batches):
        for batch in batches:
            texts, counts = [], []
            owns = batch.column(2).to_pylist() if shared.value is None else [None] * len(batch)
            for text, own in zip(batch.column(1).to_pylist(), owns, strict=True):
                again = {(x["kind"], x["entity"]): x["draw"] for x in own or ()} if shared.value is None else shared.value
                text, count = _replace(text, key, again) if text else (text, Counter())
                texts.append(text)
                counts.append(count)
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(texts, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "text"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'n_{k} long' for k in KINDS)}, text string")


def _mentions(batches):
    import numpy as np

    for batch in batches:
        rows = [(i, kind, normal(kind, t[s:e], g)) for i, t in enumerate(batch.column(0).to_pylist()) if t for s, e, kind, g in find_entities(t)]
        at = np.array([i for i, _, _ in rows], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at)), pa.array([k for _, k, _ in rows], pa.string()), pa.array([e for _, _, e in rows], pa.string())], ["text_hash", "kind", "entity"])
