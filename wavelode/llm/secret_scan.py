"""Secret scanning with an incremental ledger of content-addressed blobs.

Every version of a document is addressed by the SHA-256 of its text. The ledger records
which blob was scanned by which version of which rule set, with the findings; a scan
takes only blobs that lack a record, and findings are joined back to all versions.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound, named, new_path, others, stage

#: Fixed rules of the base set: kind, pattern, group whose length counts, its least length.
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Further rules: private key headers, web tokens, and tokens known by their prefixes. No rule reads a stretch of text again
#: from each of its characters: what cannot begin inside a run of its own characters says so.
EXTRA = (
    ("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", 0, 1),
    ("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 1),
    ("prefixed", r"(?:gh[pousr]_|xox[abprs]-|sk_live_|glpat-)[A-Za-z0-9_-]{16,}", 0, 1),
)
RULE_SETS = {"base": BASE, "extra": EXTRA}
KINDS = [rule[0] for rules in RULE_SETS.values() for rule in rules]
#: Matches that are added up one by one, and code points of a text's pieces when spans are replaced.
RUN, PIECE = 512, 2048
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def rule_version(rules) -> str:
    """A version that changes whenever a rule of the set does."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find_spans(text: Column, rule: tuple) -> Column:
    """Spans of a rule's matches, leftmost first and without overlap, by code point.

    Splitting at the matches gives the lengths between them, and so where each begins.
    Lengths are added up in runs of RUN matches and then run by run, so that texts of very
    many matches take time in proportion.
    """
    kind, pattern, group, least = rule
    regex = F.lit(pattern)
    length = lambda parts: F.transform(parts, F.char_length)
    whole = length(F.regexp_extract_all(text, regex, F.lit(0)))
    value = length(F.regexp_extract_all(text, regex, F.lit(group))) if group else whole
    matches = F.arrays_zip(length(F.split(text, pattern, -1)).alias("gap"), whole.alias("size"), value.alias("value"))
    none = F.array().cast(f"array<{SPAN}>")

    def add(done, m):
        start = done["at"] + m["gap"]
        end = start + m["size"]
        span = F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))
        # The text after the last match is a gap without a match.
        found = F.when(m["value"] >= least, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(F.coalesce(end, start).cast("int").alias("at"), found.alias("spans"))

    def one_run(run):
        return F.aggregate(run, F.struct(F.lit(0).alias("at"), none.alias("spans")), add)

    def moved(spans, by):
        return F.transform(spans, lambda x: F.struct((x["start"] + by).alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), (x["end"] + by).alias("end")))

    def joined_runs(runs):
        add_run = lambda done, run: F.struct((done["at"] + run["at"]).alias("at"), F.concat(done["spans"], F.array(moved(run["spans"], done["at"]))).alias("spans"))
        return F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("spans")), add_run, lambda done: F.flatten(done["spans"]))

    def in_runs(m):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / RUN).cast("int")), lambda i: one_run(F.slice(m, i * RUN + 1, F.lit(RUN))))

    return F.when(text.rlike(pattern), bound(matches, lambda m: joined_runs(in_runs(m)))).otherwise(none)


def scan_versions(versions: DataFrame, ledger: str | None = None) -> DataFrame:
    """Add ``findings`` to every row of ``versions``, an array of spans in order.

    ``ledger`` is the path of the ledger to use and extend; a new one in the shared folder
    is made without it. Blobs are scanned once for each rule set and version however many
    rows hold them; texts of blobs that the ledger holds in full are not moved. A null text
    is the empty text, which is a blob like any other, and an empty table gives no rows.
    A column named findings or blob, in upper or lower case, is replaced; others stay.
    Rows repeated in full keep their number. Spans are ordered by start, then by kind in
    the order of KINDS.
    """
    spark = versions.sparkSession
    ledger = ledger or new_path(spark, "ledger")
    current = {name: rule_version(rules) for name, rules in RULE_SETS.items()}
    schema = f"blob binary, rule_set string, rule_version string, findings array<{SPAN}>"

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = others(versions, "findings", "blob")
    rows = versions.select(*map(named, own), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))
    blobs = versions.select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), text.alias("text"))

    wanted = F.array(*[F.lit(x) for x in RULE_SETS])
    holds = " or ".join(f"(rule_set = '{k}' and rule_version = '{v}')" for k, v in current.items())
    if _exists(spark, ledger):
        seen = spark.read.schema(schema).parquet(ledger).where(holds).groupBy("blob").agg(F.collect_set("rule_set").alias("seen"))
        # Hashes alone say which blobs are new to a rule set; only their texts go on, once each.
        whole = seen.where(F.size("seen") == len(RULE_SETS)).select("blob")
        fresh = stage(blobs.select("blob").distinct().join(whole, "blob", "left_anti"), "fresh")
        blobs = stage(blobs.join(fresh, "blob", "left_semi"), "unseen").groupBy("blob").agg(F.first("text").alias("text"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
    else:
        blobs = blobs.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", wanted)
    todo = blobs.where(F.size("todo") > 0)
    spans = [F.struct(F.lit(k).alias("rule_set"), F.lit(current[k]).alias("rule_version"), F.when(F.array_contains("todo", k), F.concat(*[find_spans(F.col("text"), r) for r in rules])).alias("findings")) for k, rules in RULE_SETS.items()]
    scanned = todo.select("blob", F.inline(F.array(*spans))).where("findings is not null")
    scanned.write.mode("append").option("compression", "zstd").parquet(ledger)

    known = spark.read.schema(schema).parquet(ledger).where(holds).where(F.size("findings") > 0)
    known = known.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("findings"))
    # Written, so that the join deals both sides itself and Spark can split a blob that very many versions hold.
    known = stage(known, "findings")
    return rows.join(known, "blob", "left").select(*map(named, own), F.coalesce("findings", F.array().cast(f"array<{SPAN}>")).alias("findings"))


def _exists(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def joined(findings: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_digest(scanned: DataFrame) -> DataFrame:
    """Counts and digests of the findings of each row."""
    found = F.col("findings")
    of = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(found, lambda s: s["rank"] < len(BASE))
    return scanned.select("doc_id", *[of(rule[0]) for rule in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(found).alias("spans"))


def redact(text: Column, findings: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; of spans that overlap the first counts.

    The text is cut into pieces of PIECE code points, so that what stands between two
    spans is found without reading all that is before it.
    """
    none = F.array().cast("array<struct<from:int,to:int,kind:string>>")

    def keep(done, s):
        """What stands before each span that begins after the end of the one before."""
        part = F.struct(done["at"].alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))
        return F.when(s["start"] >= done["at"], F.struct(s["end"].alias("at"), F.concat(done["parts"], F.array(part)).alias("parts"))).otherwise(done)

    end = lambda done: F.concat(done["parts"], F.array(F.struct(done["at"].alias("from"), F.char_length(text).alias("to"), F.lit(None).cast("string").alias("kind"))))
    parts = F.aggregate(findings, F.struct(F.lit(0).alias("at"), none.alias("parts")), keep, end)

    def between(pieces, p):
        piece = lambda k: F.substring(F.get(pieces, k), F.greatest(p["from"] - k * PIECE, F.lit(0)) + 1, F.least(p["to"] - k * PIECE, F.lit(PIECE)) - F.greatest(p["from"] - k * PIECE, F.lit(0)))
        held = F.transform(F.sequence(F.floor(p["from"] / PIECE).cast("int"), F.floor((p["to"] - 1) / PIECE).cast("int")), piece)
        gap = F.when(p["to"] > p["from"], F.array_join(held, "")).otherwise("")
        return F.concat(gap, F.when(p["kind"].isNotNull(), F.concat(F.lit("["), p["kind"], F.lit("]"))).otherwise(""))

    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    whole = bound(pieces, lambda cut: F.array_join(F.transform(parts, lambda p: between(cut, p)), ""))
    return F.when(F.size(findings) > 0, whole).otherwise(text)
