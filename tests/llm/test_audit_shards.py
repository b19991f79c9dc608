"""Source divergence audit and stratified shards against brute force, with their odd cases."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import divergence as D
from voxloom.llm import lz_fingerprint, minmax
from voxloom.llm import sharding as H

LONG = "word " * 400_000 + "Ünique end"
DOCS = [
    (1, "The cat, the CAT and the dog!", "en", "a"), (2, "the cat sat", "en", "a"), (3, "The Dog sat; the dog", "en", "b"), (4, "the cat", "en", None), (5, None, "en", "c"), (6, "", "en", "b"),
    (7, "É été ÉTÉ été", "fr", "a"), (8, "été É", "fr", "b"), (9, "été× É x", "fr", "b"), (10, "123 !?", "de", "a"), (11, "eins", "de", "b"), (12, "text", None, None), (12, "text", None, None), (12, "text", None, ""),
    (None, "the cat", "en", "a"), (13, "the\x00cat the_dog", "en", "b"), (14, "zeta alpha omega " * 3, "en", "c"), (15, "zeta alpha omega", "en", "a"), (16, "zeta alpha omega", "en", "b"), (17, LONG, "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def terms(text):
    found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in found]


def brute(docs, k=200, least=3):
    docs = [(t or "", g or "", s or "") for _, t, g, s in docs]
    rows = []
    for lang in {g for _, g, _ in docs}:
        own = [(terms(t), s) for t, g, s in docs if g == lang]
        frequency = Counter(x for t, _ in own for x in set(t))
        kept = sorted(x for x, n in frequency.items() if n >= least)
        counts = defaultdict(Counter)
        for t, s in own:
            counts[s].update(x for x in t if frequency[x] >= least)
        total = sum(counts.values(), Counter())
        p = lambda c, x: 1 + 1_000_000_000 * (c[x] + 1) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in counts.items():
            pairs = [(-sum(f(p(c, x), p(o, x)) for x in kept), other.encode(), other) for other, o in counts.items() if other != s]
            tops = [(-f(p(c, x), p(total, x)), x.encode(), x) for x in kept if c[x] and p(c, x) > p(total, x)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(tops)[:k])):
                rows += [(lang, s, part, item, -v, r) for r, (v, _, item) in enumerate(found, 1)]
    return sorted(rows)


def audited(df, **more):
    pairs, tops = D.audit(df, **more)
    both = pairs.selectExpr("lang", "source", "'pair'", "other", "value", "rank").union(tops.selectExpr("lang", "source", "'term'", "term", "value", "rank"))
    return sorted(map(tuple, both.collect()))


def test_audit_against_brute_force(spark):
    df = spark.createDataFrame(DOCS, SCHEMA).withColumns({"term": F.lit("clash"), "n": F.lit(1), "p": F.lit(2.0), "bucket": F.lit(3), "gid": F.lit(4)})
    assert audited(df) == brute(DOCS)
    assert audited(df, k=1, min_docs=1) == brute(DOCS, 1, 1)


def test_audit_of_the_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert audited(df) == brute([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()])
    assert audited(df, k=3) == brute([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()], 3)


def test_audit_without_broadcasts(spark, monkeypatch):
    """The paths for tables that are too large to be broadcast, small chunks and many waves."""
    for name, value in {"BROADCAST_ROWS": 0, "ROWS_A_PLACE": 3, "WAVE": 2, "PAIRS": 2}.items():
        monkeypatch.setattr(D, name, value)
    few = DOCS[:-1]
    assert audited(spark.createDataFrame(few, SCHEMA), k=2, min_docs=1) == brute(few, 2, 1)


def test_audit_ties_and_nothing(spark):
    same = [(k, " ".join(f"t{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(20)), "en", "ab"[k % 2]) for k in range(6)] + [(9, "common", "en", "c")]
    assert audited(spark.createDataFrame(same, SCHEMA)) == brute(same)
    assert audited(spark.createDataFrame([], SCHEMA)) == []
    assert audited(spark.createDataFrame([(1, "12", "x", "y"), (2, None, None, None)], SCHEMA)) == []


def test_probabilities_are_exact(spark):
    cases = [(0, 0, 1), (10**14, 10**15, 10**6), (7, 9, 3), (9 * 10**14, 9 * 10**14, 1), (123456789012, 987654321098, 55555)]
    rows = spark.createDataFrame(cases, "n long, size long, terms long").withColumn("p", D.probability("n", "size", "terms")).collect()
    assert [r["p"] for r in rows] == [1 + 10**9 * (n + 1) // (s + v) for n, s, v in cases]
    assert spark.createDataFrame([(0, 0, 0)], "n long, size long, terms long").select(D.probability("n", "size", "terms").alias("p")).first()["p"] is None


# --- shards --------------------------------------------------------------------------------------


def check_shards(rows, docs, shards):
    assert len(rows) == len(docs)
    own = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["source"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, s or "", own(t), zlib.crc32((t or "").encode())) for d, t, _, s in docs)
    held = defaultdict(list)
    for r in rows:
        held[r["shard"]].append(r)
    sizes = [len(held[k]) for k in range(shards)]
    assert sum(sizes) == len(docs) and max(sizes) - min(sizes) <= 1 and set(held) <= set(range(shards))
    for part in held.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    sources = Counter(s or "" for *_, s in docs)
    for source, n in sources.items():
        for k in range(shards):
            mine = sum(r["source"] == source for r in held[k])
            assert abs(mine - n / shards) <= 2 + n * len(sources) / len(docs), (source, k)


def test_shards_match_the_mixture(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]
    for shards in (1, 3, 8):
        check_shards(H.assign_shards(df, shards).collect(), docs, shards)
    one, two = (sorted(map(tuple, H.assign_shards(f, 8).collect()), key=str) for f in (df, df.repartition(7).orderBy(F.desc("doc_id"))))
    assert one == two
    assert sorted(map(tuple, H.assign_shards(df, 8, seed=5).collect()), key=str) != one


def test_shards_of_odd_rows(spark, monkeypatch):
    """Null and repeated ids, null and empty texts, a third of all rows alike, ranges of two rows, copies dealt out."""
    docs = [*DOCS[:-1], *[(77, "copy", "en", "hot")] * 40, *[(None, None, None, None)] * 9, (1, "", "en", "a")]
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"hash": F.lit("clash"), "copies": F.lit(9), "range": F.lit(1), "size": F.lit(2), "slot": F.lit(3)})
    plain = sorted(map(tuple, H.assign_shards(df, 8).collect()), key=str)
    check_shards(H.assign_shards(df, 8).collect(), docs, 8)
    for name, value in {"RANGE_ROWS": 2, "COPIES": 3, "BLOCK": 2}.items():
        monkeypatch.setattr(H, name, value)
    assert sorted(map(tuple, H.assign_shards(df, 8).collect()), key=str) == plain
    assert H.assign_shards(df.limit(0)).count() == 0
    check_shards(H.assign_shards(df.limit(3), 8).collect(), [tuple(r)[:4] for r in df.limit(3).collect()], 8)
    with pytest.raises(ValueError):
        H.assign_shards(df, 0)


def test_shards_are_written_with_their_texts(spark, tmp_path):
    docs = [*DOCS[:-1], *[(77, "copy", "en", "hot")] * 5]
    df = spark.createDataFrame(docs, SCHEMA)
    out = H.write_shards(df, f"file://{tmp_path}/shards", 4)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter((d, t) for d, t, *_ in docs)
    slots = defaultdict(list)
    for r in out.collect():
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 4 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_run_no_python(spark, sf_dir):
    plan = H.assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- hashes of words and phrases -----------------------------------------------------------------


def thue_morse(n):
    t = "a"
    for _ in range(n):
        t += t.translate(str.maketrans("ab", "ba"))
    return t


def test_words_that_powers_of_a_base_confuse(spark):
    """Powers of any odd base modulo 2**64 give these two words one hash."""
    t = thue_morse(11)
    u = t.translate(str.maketrans("ab", "ba"))
    assert len({int(minmax.shingles(x, 5)[0]) for x in (t, u)}) == 2
    docs = [(1, t), (2, u), (3, f"{t} one two three four five six"), (4, f"{u} one two three four five six"), (5, t)]
    found = {r["doc_id"]: r["component_id"] for r in minmax.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=4).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def phrases(text):
    """Phrases of a text, one by one."""
    known, part = set(), ""
    for c in text:
        part += c
        if part not in known:
            known.add(part)
            part = ""
    return known


def test_signature_is_of_the_phrase_set(spark, sf_dir):
    some = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()] + ["", "a", "aaaa", "äöü€😀" * 9, thue_morse(9)]
    for text in some:
        hashes = set()
        for phrase in phrases(text):
            points = np.frombuffer(phrase.encode("utf-32-le"), "u4")
            h = lz_fingerprint.phrase_hashes(points, *(np.array([x]) for x in (0, len(points))))
            hashes.add(int(h[0]) >> 32)
        assert sorted(hashes)[: lz_fingerprint.K] == lz_fingerprint.read(lz_fingerprint.written(lz_fingerprint.of_text(text))).tolist()
