"""Letters outside Latin, near misses of rules in very long texts, null ids, and buckets one by one."""

import time
from array import array

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wavelode.llm import decontaminate, secret_scan, shards, surrogate
from wavelode.llm.tokens import Encoder


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_every_letter_before_every_mark_has_the_library_s_ids(name, spaced):
    tool = Encoder(str(public_tokenizers.path(name)), spaced)
    texts = [c + m for c in map(chr, range(0x110000)) if c.isalpha() for m in ".,;:!?"]
    for lo in range(0, len(texts), 100_000):
        some = texts[lo : lo + 100_000]
        want = tool.library.encode_batch(some, add_special_tokens=False)
        assert [t for t, w in zip(some, want, strict=True) if tool.encode(t) != array("I", w.ids).tobytes()] == []


NEAR_MISSES = ("eyJ", "eyJabcdefgh.", "eyJabcdefgh.eyJabcdefgh", "token ", "token=", "password  ", "AKIA", "0123456789abcde ", "0123456789abcdeg", "-----BEGIN A ", "ghp_", "sk_live_a ", "xoxb-")


@pytest.mark.parametrize("piece", NEAR_MISSES)
def test_rules_take_time_in_proportion(spark, piece):
    """A megabyte of what a rule nearly matches."""
    text = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    secret_scan.scan_versions(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert time.perf_counter() - began < 40


def test_web_tokens_begin_where_no_token_character_precedes(spark):
    token = "eyJabcdefgh.abcdefgh1.abcdefgh2"
    text = f"{token} x{token} ={token}. -{token}"
    found = secret_scan.scan_versions(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().findings
    assert [(s.start, s.end) for s in found if s.kind == "web_token"] == [(0, 31), (66, 97)]


@pytest.mark.parametrize("piece", ["%a1", "a.", "a@", "a@b.", "1 ", "+1 ", "4111 ", "1.2.", "::", "ab:", "DE12", "Mr ", "Mr Aa", "A-", "Aa-"])
def test_entities_take_time_in_proportion(piece):
    text = "a@b " + piece * (1_000_000 // len(piece)) + "@"
    began = time.perf_counter()
    surrogate.find_entities(text)
    assert time.perf_counter() - began < 30


def test_copies_of_an_item_are_searched_once_and_many_windows_are_not_sent(spark, monkeypatch):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame([(1, f"so {words} then"), (2, "none of these"), (3, words.upper())], "doc_id long, text string")
    bench = spark.range(200).select(F.col("id").alias("item_id"), F.lit(words).alias("text"))
    expected = {(d, i, at, 12) for d, at in ((1, 1), (3, 0)) for i in range(200)}
    plans, stage = [], decontaminate.stage

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return stage(df, name)

    monkeypatch.setattr(decontaminate, "stage", noted)
    # The windows of one copy are sent, though those of all are too many.
    monkeypatch.setattr(decontaminate, "SENT_WINDOWS", 12 * len(decontaminate.MASKS))
    assert {tuple(r) for r in decontaminate.overlaps(docs, bench).collect()} == expected and not plans
    monkeypatch.setattr(decontaminate, "SENT_WINDOWS", 0)
    assert {tuple(r) for r in decontaminate.overlaps(docs, bench).collect()} == expected
    assert [r.doc_id for r in decontaminate.without_overlaps(docs, bench).collect()] == [2]
    hits = [plan for name, plan in plans if name == "hits"]
    # Of the two joins only the one with the filter may send a table.
    assert len(hits) == 2 and all("SortMergeJoin" in p and p.count("BroadcastHashJoin") == 1 for p in hits)


@pytest.mark.parametrize("sent", [decontaminate.SENT_WINDOWS, 0])
def test_items_without_id_and_ids_of_two_items(spark, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "SENT_WINDOWS", sent)
    items = [(None, "one two three four five six seven"), (None, "red green blue white black grey pink"), (7, "alpha beta gamma delta epsilon zeta"), (7, "uno dos tres cuatro cinco seis")]
    docs = [(1, "x " + items[0][1]), (2, items[1][1]), (3, items[2][1] + " y " + items[3][1]), (4, "nothing of the kind"), (5, "word " * 200_000 + items[0][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start, r.matched) for r in decontaminate.overlaps(d, b).collect()}
    assert got == {(1, None, 1, 7), (2, None, 0, 7), (3, 7, 0, 6), (5, None, 200_000, 7)}
    assert [r.doc_id for r in decontaminate.without_overlaps(d, b).collect()] == [4]


def test_two_passes_equal_plain_ones(spark):
    """Rows are in the shards as scattering by the seeded hash and laying the buckets end to end puts them; each bucket is permuted."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 50).cast("int")).alias("text"))
    seed, n = 77, 13
    size = docs.agg(F.sum(F.octet_length("text") + 24)).first()[0]
    out = shards.shuffle_to_shards(docs, shards=5, seed=seed, bucket_bytes=-(-size // n)).collect()
    own = {r.doc_id: r.b for r in docs.select("doc_id", F.pmod(shards._own(seed), F.lit(n)).alias("b")).collect()}
    placed = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert [own[i] for i in placed] == sorted(own.values())
    assert sorted(placed) == list(range(3000)) and [sum(r.shard == s for r in out) for s in range(5)] == [600] * 5
    for b in range(n):
        mine = [i for i in placed if own[i] == b]
        assert mine != sorted(mine)
    again = shards.shuffle_to_shards(docs.repartition(7), shards=5, seed=seed, bucket_bytes=-(-size // n)).collect()
    assert [r.doc_id for r in sorted(again, key=lambda r: (r.shard, r.slot))] == placed


def test_a_bucket_is_a_partition(spark):
    rows = spark.range(400).select((F.col("id") % 40).cast("int").alias("bucket"))
    parts = rows.repartitionById(40, "bucket").select(F.spark_partition_id().alias("p"), "bucket").distinct().collect()
    assert sorted((r.p, r.bucket) for r in parts) == [(i, i) for i in range(40)]


def test_a_name_is_one_entity_under_all_titles():
    """Also where a title tells no gender: the text's other mentions do, else the lists of names."""
    key = b"k" * 32
    both, alone, unknown = (surrogate._replace(t, key, {})[0].split() for t in ("Mrs Quinta Keller met Dr Quinta Keller", "Dr Anna Keller", "Dr Quinta Keller"))
    assert both[1] == both[5] and both[2] == both[6] and both[1] in surrogate.GIVEN["latin", "f"]
    assert alone[1] == surrogate._replace("Frau Anna Keller", key, {})[0].split()[1] and unknown[1] not in ("Quinta",)


def test_numbers_without_gaps_after_a_plus(spark):
    found = surrogate.find_entities("call +493012345678 or 1+493012345678 or x+493012345678.")
    assert [(a, b, k) for a, b, k, _ in found] == [(5, 18, "phone")]
    new = surrogate._replace("call +493012345678 now", b"k" * 32, {})[0]
    assert new.startswith("call +") and len(new) == 22 and "493012345678" not in new
