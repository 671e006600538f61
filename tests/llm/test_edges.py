"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tablewright.llm import (
    components, exact_dedup, jaccard, language, mixing, packing, records, secret_scan, substring_dedup, topk, toxicity,
)
from tablewright.llm.common import Words, split_by_marks
from tablewright.llm.queries import END_ID, TOKENIZER
from tablewright.llm.sketch import Estimates, Shape, Windows, _merge, _parts, pack_gaps, unpack_gaps
from tests.llm import brute

import public_tokenizers

PATH = public_tokenizers.path(TOKENIZER)
SENTENCE = "the quick brown fox jumps over the lazy dog while seven other foxes look on from the old garden wall"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, bucket int, h string, p double, key string, row int, n int"


def frame(spark, rows):
    """Rows of id, text, lang and source, beside columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "h", 0.5, "k", 2, 3) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    texts = [
        (1, SENTENCE), (2, SENTENCE), (3, SENTENCE.upper()), (4, None), (5, ""), (6, " \t\n "), (7, LONG), (8, LONG + " end"),
        (9, "one"), (10, "One"), (11, "a b c"), (12, "ÀÉ «ß» 中文 don't <|endoftext|> x's"), (13, "1234 5678 !!"),
        (14, SENTENCE.replace(" ", " ")), (15, SENTENCE.replace(" ", "  \r\n")), (16, SENTENCE + " tail " + SENTENCE),
    ]
    return frame(spark, [(d, t, "en", f"s{d % 3}") for d, t in texts])


@pytest.fixture(scope="module")
def doubled(spark):
    """Repeated rows, rows of one id, and null ids."""
    rows = [(1, SENTENCE, "en", None), (1, SENTENCE, "en", None), (2, "two words", None, "a"), (2, "other words", "en", "a"),
            (None, SENTENCE, "en", "a"), (None, None, None, None), (None, None, None, None)]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def rows(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=str)


# ---- token records ----


def written(spark, df, tmp_path, **how):
    path = f"file://{tmp_path}/r"
    records.write_token_records(df, path, PATH, END_ID, **how)
    return path


def test_records_round_trip(spark, odd, tmp_path):
    path = written(spark, odd, tmp_path, files=3)
    back = records.read_token_records(spark, path)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in back.collect()}
    docs = sorted(texts_of(odd))
    assert got == dict(zip([d for d, _ in docs], brute.token_ids([t for _, t in docs]), strict=True))
    index = records.read_index(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in index] == sorted(got)
    assert [r.start for r in index] == np.cumsum([0, *(len(got[r.doc_id]) for r in index)])[:-1].tolist()
    assert sorted(r.doc_id for r in records.shuffled_index(spark, path, 1).collect()) == sorted(got)


def test_records_repeated_and_empty(spark, doubled, empty, tmp_path):
    back = records.read_token_records(spark, written(spark, doubled, tmp_path / "a"))
    assert sorted((str(r.doc_id) for r in back.collect())) == ["1", "1", "2", "2", "None", "None", "None"]
    assert records.read_token_records(spark, written(spark, empty, tmp_path / "b")).count() == 0


def test_records_files_grow_with_the_texts(odd, monkeypatch):
    monkeypatch.setattr(records, "FILE_BYTES", 10_000)
    size = odd.agg(F.sum(F.octet_length("text"))).first()[0]
    assert records._files_for(odd, "text") == -(-size // 10_000) > 100
    monkeypatch.setattr(records, "FILE_BYTES", 1 << 40)
    assert records._files_for(odd, "text") == 8 == records._files_for(odd.limit(0), "text")


def test_records_notice_damage():
    good = records.frame(b"payload") + b"\n"
    assert [p for _, _, p in records.unframe(good * 2)] == [b"payload"] * 2
    for at in (0, 9, 14, len(good) - 3):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(records.unframe(bytes(bad)))
    with pytest.raises(ValueError):
        list(records.unframe(good[:-4]))


# ---- packing ----


def test_packing_odd(spark, odd, doubled, empty):
    pieces = packing.pack_documents(odd, PATH, END_ID, held_tokens=5000).withColumn("crc", F.crc32("ids"))
    brute.check_packing(texts_of(odd), rows(pieces, "doc_id", "start", "length", "crc", "doc_tokens", "sequence_id", "offset"))
    total = packing.pack_documents(doubled, PATH, END_ID).agg(F.sum("length")).first()[0]
    assert total == sum(map(len, brute.token_ids([t for _, t in texts_of(doubled)])))
    assert packing.pack_documents(empty, PATH, END_ID).count() == 0


def test_packing_tiers_and_groups():
    rng = np.random.default_rng(3)
    tails = [(int(n), i, 0) for i, n in enumerate(rng.integers(1, 4096, 400))]
    windows, rest = packing.pack_tails(tails, packing.TIERS)
    assert all(sum(p[0] for p in inside) == tier for tier, inside in windows)
    assert {t for t, _ in windows} <= set(packing.TIERS)
    closed = packing.close_out(rest, 1)
    assert sum(p[0] for _, w in windows + closed for p in w) == sum(t[0] for t in tails)
    groups = packing.step_groups(windows, 8)
    for g in set(groups):
        assert len({windows[i][0] for i in range(len(windows)) if groups[i] == g}) == 1
        assert groups.count(g) <= 8


# ---- substring dedup ----


def test_substrings_odd(spark, odd, empty):
    got = substring_dedup.remove_repeats(odd, bucket_bytes=200_000)
    exp = {d: (n, k) for d, n, k, _ in brute.substring_dedup(texts_of(odd))}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got.collect()} == exp
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substrings_without_ids(spark, doubled):
    got = rows(substring_dedup.remove_repeats(doubled), "doc_id", "n_words", "n_removed")
    n = len(SENTENCE.split())
    assert got == sorted([(1, n, 0), (1, n, 0), (2, 2, 0), (2, 2, 0), (None, n, n), (None, 0, 0), (None, 0, 0)], key=str)


def test_gaps_round_trip():
    rng = np.random.default_rng(0)
    for n, most in ((0, 1), (1, 1), (5, 6), (300, 70_000), (50, 10**9), (4000, 4096)):
        values = np.sort(rng.choice(most, n, replace=False)) if most < 10**6 else np.unique(rng.integers(0, most, n))
        assert unpack_gaps(pack_gaps(values)).tolist() == values.tolist()
    assert unpack_gaps(pack_gaps(np.array([0, 254, 255, 510, 765]))).tolist() == [0, 254, 255, 510, 765]


def test_gaps_are_small():
    """Sparse cells, as a bucket of many has them, take two bits each more than the mean gap has."""
    values = np.unique(np.random.default_rng(1).integers(0, 60_000 * 4000, 4000))
    data = pack_gaps(values)
    assert unpack_gaps(data).tolist() == values.tolist() and len(data) * 8 < len(values) * 18.5


def test_sketch_of_one_row():
    """Counts from one row are never below the number of documents, and half as much travels."""
    texts = [" ".join(f"w{(i * k) % 97}" for k in range(40)) for i in range(60)]
    sent, shapes = [], [Shape(3, True, True, 2, 16, 2, 1), Shape(3, True, True, 2, 14, 2, 2)]
    for shape in shapes:
        halves = [pa.table({"bucket": pa.array([b] * 30, pa.int32()), "text": texts[30 * b : 30 * b + 30]}) for b in (0, 1)]
        parts = pa.concat_tables([_parts(shape)(t) for t in halves])
        assert set(parts["sketch_row"].to_pylist()) == set(range(shape.rows))
        sent.append(sum(map(len, parts["gaps"].to_pylist())))
        blocks = [parts.filter((pc.field("sketch_row") == r) & (pc.field("block") == b)) for r in range(shape.rows) for b in range(4)]
        back = pa.concat_tables([_merge(shape)(b) for b in blocks if b.num_rows])
        held = Counter(h for t in texts for h in set(Windows.of([t.encode()], shape).hashes[0].tolist()))
        for b in (0, 1):
            w = Windows.of([t.encode() for t in texts[30 * b : 30 * b + 30]], shape)
            counts = Estimates(back.filter(pc.field("bucket") == b), shape).counts(w.hashes)
            assert all(c >= held[h] for c, h in zip(counts.tolist(), w.hashes[0].tolist(), strict=True))
    assert sent[0] < 0.75 * sent[1]


def test_split_by_marks(spark):
    """Keys that are there are always found, few others are, and with too few marks all still come out once."""
    data = spark.range(4000).select(F.when(F.col("id") > 3, F.col("id")).alias("key"), F.col("id").cast("string").alias("row"))
    key = F.struct(F.col("key").isNull().alias("none"), "key").alias("key")
    held, some = data.select("row", key), data.filter("id % 40 = 0").select(key)
    for most in (4096, 1):
        rest, may = (x.select("row").collect() for x in split_by_marks(held, some, "key", most))
        assert sorted(int(r.row) for r in rest + may) == list(range(4000))
        assert {r.row for r in may} >= {str(i) for i in range(0, 4000, 40)} | {"1", "2", "3"}
        assert len(may) < 500
    rest, may = split_by_marks(held, some.limit(0), "key")
    assert rest.count() == 4000 and may.count() == 0


def test_near_copies_leave_other_rows_where_they_are(spark, monkeypatch):
    """Texts without near copies do not travel to the join with the rows that go."""
    from corpus_pipeline import near_dedup_stage

    docs = frame(spark, [(i, " ".join(f"w{i}_{k}" for k in range(30)), "en", "s") for i in range(300)]
                 + [(1000 + i, " ".join(f"w{i}_{k}" for k in range(30)) + " end", "en", "s") for i in range(5)])
    travel = []

    def split(*how):
        found = split_by_marks(*how)
        travel.append(found[1].count())
        return found

    monkeypatch.setattr(jaccard, "split_by_marks", split)
    kept = near_dedup_stage(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(300))
    assert len(travel) == 1 and 5 <= travel[0] < 100


def test_mix_sends_no_row_a_document_through_the_driver(spark, capsys):
    docs = frame(spark, [(i, f"some words {i}", "en", f"s{i % 3}") for i in range(300)])
    mixing.take_mix(docs).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_windows_of_words():
    w = Words([b"a b c", b"", b"d e"], lower=False)
    assert [list(map(int, x)) for x in w.windows(2)] == [[0, 1, 3], [1, 2, 4]]
    assert [list(map(int, x)) for x in w.windows(3, short=True)] == [[0, 3], [2, 4]]


# ---- language ----


def test_language_odd(spark, odd, doubled, empty):
    got = {r.doc_id: r for r in language.identify_languages(odd).collect()}
    assert {d for d, r in got.items() if r.lang_pred == "und"} == {4, 5, 6, 13}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify_languages(doubled).count() == 7
    assert language.identify_languages(empty).count() == 0
    nothing_known = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify_languages(nothing_known).collect()} == {"und"}
    kept = language.drop_unidentified(odd)
    assert kept.columns == odd.columns and kept.count() == 12


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.95


# ---- secrets ----


def brute_spans(text):
    out = []
    for rank, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(("(?ai)" if rule.any_case else "(?a)") + rule.pattern, text or ""):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), rank, rule.kind, m.end()))
    return sorted(out)


def test_secrets(spark, odd, empty):
    texts = [
        None, "", "token=api_key:longvalue123", "API_KEY = 'abcdefgh' pass", "\x01 token: \x01abcdefgh \x01" + "a" * 40,
        "é😀 PASSWORD:\"12345678\" AKIAAKIA1234567890 ghp_" + "a" * 36, "token=ab secret: xyz12345678 " * 50,
        "ſecret=abcdefghi toKen=abcdefghi", "-----BEGIN RSA PRIVATE KEY----- eyJabcdefghi.abcdefghij.abcdefghik",
        "x" * 200_000 + " token=abcdefgh", "AKIA123 AKIA123456789012 " + "0123456789abcdef" * 2 + "G" + "f" * 31,
        "xoxb-1234567890-abc ghx_" + "b" * 40, LONG,
    ]
    df = frame(spark, [(i, t, "en", None) for i, t in enumerate([*texts, texts[3]])])
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.find_secrets(df).collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate([*texts, texts[3]])}
    assert secret_scan.find_secrets(empty).count() == 0


def test_secrets_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.find_secrets(docs).collect()}
    assert got == {d: brute_spans(t) for d, t in texts_of(docs)}


def test_trigram_queries():
    rule = secret_scan.Rule
    assert secret_scan.trigram_query(rule("k", "abcdx+[0-9]")) == [[frozenset({"abc", "bcd"})]]
    assert secret_scan.trigram_query(rule("k", "[0-9]+")) == []
    assert secret_scan.trigram_query(rule("k", "(ab|cd)ef")) == [[frozenset({"abe", "bef"}), frozenset({"cde", "def"})]]
    assert secret_scan.trigram_query(rule("k", "(abc)?[0-9]+")) == []
    assert secret_scan.trigram_query(rule("k", "ABCD", any_case=True)) == [[frozenset({"abc", "bcd"})]]


# ---- mixing ----


def test_mixing_balance(spark):
    rng = np.random.default_rng(5)
    data = [(i, "w " * int(n), "en", ["a", "b", None][i % 3] if i % 2 else "a") for i, n in enumerate(rng.integers(0, 60, 900))]
    df = frame(spark, data)
    for block in (20_000, 40):
        got = mixing.mix_sources(df, block_rows=block).collect()
        assert len(got) == 900 and all(r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in got)
        total = sum(r.size for r in got)
        targets = {r.source: (r.target, r.source_size) for r in got}
        assert math.isclose(sum(t for t, _ in targets.values()), 1.5 * total, rel_tol=1e-9)
        for source, (target, size) in targets.items():
            taken = sum(r.taken for r in got if r.source == source)
            assert target <= 2 * size + 1e-9 and abs(taken - target) <= 60
    again = rows(mixing.mix_sources(df, block_rows=40), "doc_id", "copies")
    assert again == rows(mixing.mix_sources(df.repartition(5), block_rows=40), "doc_id", "copies")


def test_mixing_edges(spark, doubled, empty):
    got = mixing.mix_sources(doubled).collect()
    assert len(got) == 7 and mixing.mix_sources(empty).count() == 0
    nothing = frame(spark, [(1, None, None, None), (2, " ", None, "a")])
    assert {(r.target, r.taken) for r in mixing.mix_sources(nothing).collect()} == {(0.0, 0)}
    taken = mixing.take_mix(doubled)
    assert taken.columns == doubled.columns
    assert sum(len(brute.words(t)) for _, t in texts_of(taken)) == sum(r.taken for r in got)


def test_flight_keeps_sums():
    rng = np.random.default_rng(1)
    p, x = rng.random(500), rng.integers(0, 1000, 500).astype(float)
    q = mixing.flight(p, x, np.random.default_rng(2))
    assert math.isclose(p.sum(), q.sum()) and math.isclose((p * x).sum(), (q * x).sum())
    assert ((q > 1e-6) & (q < 1 - 1e-6)).sum() <= 2


# ---- top k ----


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(0, 0.2, 8).tolist() for _ in range(300)]
    data = [(i, v) for i, v in enumerate(vectors)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [math.inf] * 8),
            (304, vectors[7]), (305, vectors[7]), (None, vectors[1]), (306, [0.5, 0.5]), (307, []), (308, [1e6] * 8), (309, [-1e6] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * x) for x in v] for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for block in (16_384, 64):
        got = topk.top_k(df, df.filter("vec_id % 20 = 0 or vec_id in (304, 306, 308)"), 5, 64, block_rows=block)
        exp = []
        for q in whole:
            if q % 20 == 0 or q in (304, 306, 308):
                scores = [(-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])]
                exp += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:5])]
        assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(exp, key=str)
    assert topk.top_k(df.limit(0), df.limit(0), 5, 64).count() == 0


# ---- toxicity ----


def test_toxicity(spark, odd, empty):
    bad = [(i, f"{SENTENCE} you {'idiot' if i % 2 else 'friend'} number {i}", "en", None) for i in range(200)]
    docs = frame(spark, bad)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit(1).alias("quality")).filter("doc_id < 120")
    got = {r.doc_id: r for r in toxicity.classify_toxicity(docs, labels, ["quality", "toxic"]).collect()}
    assert [d for d in range(120, 200) if got[d].flagged] == list(range(121, 200, 2))
    nothing = toxicity.classify_toxicity(odd, labels.filter("doc_id < 0"), ["toxic"])
    assert nothing.filter("flagged or p_toxic > 0").count() == 0 and nothing.count() == 16
    assert toxicity.classify_toxicity(empty, labels, ["toxic"]).count() == 0


# ---- Jaccard join ----


def test_jaccard_odd(spark, odd, empty):
    got = jaccard.similar_groups(odd, bucket_bytes=200_000)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_components(texts_of(odd)), key=str)
    assert jaccard.similar_groups(empty).count() == 0


def test_jaccard_chains(spark):
    """Near copies of near copies, below and above the bound, in one large group."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(int(rng.integers(0, 5))):
            words[int(rng.integers(0, 120))] = f"v{rng.integers(0, 50)}"
        docs.append((i, " ".join(words)))
    docs += [(200 + i, " ".join([f"c{i}", *base[:40], *[f"u{i}_{k}" for k in range(10)]])) for i in range(20)]
    got = jaccard.similar_groups(frame(spark, [(d, t, None, None) for d, t in docs]))
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_components(docs), key=str)


def test_jaccard_of_large_groups(spark):
    """More near copies than pivots, many of them unlike any pivot, and other texts in their lists."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(260):
        words = list(base)
        for at in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            words[at] = f"v{rng.integers(0, 30)}"
        docs.append((i, " ".join(words)))
    docs += [(300 + i, " ".join(base[: 30 + i % 30] + [f"u{i % 7}_{k}" for k in range(i % 9)])) for i in range(80)]
    got = jaccard.similar_groups(frame(spark, [(d, t, None, None) for d, t in docs]))
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_components(docs), key=str)


def thue_morse(n, one, other):
    word = [one]
    while len(word) < n:
        word += [other if x == one else one for x in word]
    return word


def test_texts_made_to_clash(spark):
    """Words and sequences for which polynomials modulo a power of two have one value."""
    a, b = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    texts = ["".join(a), "".join(b), " ".join(["".join(a)] * 14), " ".join(["".join(b)] * 14), " ".join(a[:40]), " ".join(b[:40])]
    docs = list(enumerate(texts))
    df = frame(spark, [(d, t, None, None) for d, t in docs])
    got = jaccard.similar_groups(df)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_components(docs), key=str)
    left = substring_dedup.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept"))
    assert rows(left) == sorted(brute.substring_dedup(docs), key=str)


def test_jaccard_repeated(spark, doubled):
    got = rows(jaccard.similar_groups(doubled), "doc_id", "component_id")
    assert got == sorted([(1, 1), (1, 1), (2, 2), (2, 2), (None, 1), (None, None), (None, None)], key=str)
    kept = jaccard.drop_near_copies(doubled)
    assert kept.columns == doubled.columns
    assert rows(kept, "doc_id", "text") == sorted(
        [(1, SENTENCE), (2, "other words"), (2, "two words"), (None, None), (None, None)], key=str
    )


def test_near_copies_by_id_and_text(spark):
    """Null ids, unlinked texts of one id, and one near copy of two rows of an id, in the stage."""
    from corpus_pipeline import near_dedup_stage

    other = " ".join(f"o{i}" for i in range(60))
    third = " ".join(f"t{i}" for i in range(60))
    fourth = " ".join(f"f{i}" for i in range(60))
    data = [
        (None, other), (None, other + " a"), (None, other + " b"), (None, other),  # only null ids: one stays
        (3, SENTENCE), (None, SENTENCE), (None, SENTENCE + " end"),  # null ids beside an id: the id stays
        (2, "two words"), (2, "other words"),  # unlinked texts of one id: both stay
        (5, third), (6, third + " x"), (6, fourth),  # one row of id 6 is a copy: only that one goes
        (7, "alone here"), (7, "alone here"),  # alike in id and text: one stays
        (None, None), (None, None), (8, ""), (8, ""),  # no words: all stay
    ]
    docs = frame(spark, [(d, t, "en", "s") for d, t in data])
    kept = near_dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    got = rows(kept, "doc_id", "text")
    first = [r for r in got if r[0] is None and r[1]]
    assert len(first) == 1 and first[0][1].startswith(other)
    rest = [(3, SENTENCE), (2, "two words"), (2, "other words"), (5, third), (6, fourth), (7, "alone here"),
            (None, None), (None, None), (8, ""), (8, "")]
    assert sorted(set(got) - set(first), key=str) == sorted(set(rest), key=str) and len(got) == len(rest) + 1


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (9, 8), (2, 9), (20, 21), (21, 22), (30, 30)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert rows(got, "node", "root") == sorted([(n, 2) for n in (2, 3, 4, 5, 8, 9)] + [(n, 20) for n in (20, 21, 22)], key=str)


def test_language_stage_without_labels(spark):
    """No label at all, and labels on held-out rows only: clean texts stay."""
    from corpus_pipeline import language_stage

    texts = [SENTENCE, "ÀÉ «ß» 中文", None, "", "1234 5678 !!", "one more text"]
    held = [r.id for r in spark.range(60).filter(language.is_held_out("id")).limit(6).collect()]
    for docs in ([(i, t, None, "s") for i, t in enumerate(texts)], [(i, t, "en", "s") for i, t in zip(held, texts, strict=True)]):
        docs = frame(spark, docs)
        kept = language_stage(spark, docs, "")
        assert kept.columns == docs.columns
        assert sorted(r.text for r in kept.collect()) == sorted(t for t in texts if t and any(c.isalpha() for c in t))


CLASHING = (
    "row place copies alike answer kept turn n digest text_sha256 n_chars set_id root best _digest _chars _copy _copies "
    "_id _source _size _rows _own _answer _n _hash _h count size copy known"
).split()


def test_stages_leave_columns_of_any_names(spark):
    """The stages' own names, a dot and a backtick in names: all values come back as they were."""
    import corpus_pipeline

    data = [(1, SENTENCE, "en", "a"), (2, SENTENCE, "en", "a"), (None, "one more text", "en", None), (None, "one more text", "en", None),
            (5, "and yet another text", "en", "b")]
    names = [*CLASHING, "with.dot", "with`tick"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    docs = spark.createDataFrame([(*r, *[f"{n}{i % 3}" for n in names]) for i, r in enumerate(data)], schema)
    given = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns, name
        found = [tuple(r) for r in kept.collect()]
        assert found and set(found) <= given, name
    assert len(set(tuple(r) for r in corpus_pipeline.exact_dedup_stage(spark, docs, "").collect())) == 3
    assert corpus_pipeline.packing_stage(spark, docs, "").count() > 0


def test_stages_on_empty_tables(spark, empty):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, empty, "")
        assert found.count() == 0 and (name == "packing" or found.columns == empty.columns)


# ---- exact dedup ----


def test_exact_odd(spark, odd, empty):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd).collect()}
    assert got[1] == (15, 3, False) and got[15] == (15, 3, True) and got[2] == (15, 3, False)
    assert got[6] == (6, 3, True) and got[4] == (6, 3, False) and got[5] == (6, 3, False)
    assert got[14] == (14, 1, True)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_repeated(spark, doubled):
    got = exact_dedup.exact_groups(doubled)
    assert got.count() == 7 and got.filter("kept").count() == 4
    assert rows(got.filter("kept"), "doc_id", "group_size") == sorted([(1, 3), (2, 1), (2, 1), (None, 2)], key=str)
    kept = exact_dedup.drop_exact_copies(doubled)
    assert kept.columns == doubled.columns and kept.count() == 4


def test_exact_clashing_identifiers(spark, odd):
    """Documents with an identifier of several contents are told apart by their digest."""
    found = exact_dedup.recipes(odd).withColumn("recipe", F.lit(bytes(16)))
    clash = spark.createDataFrame([(bytes(16),)], "chunk_hash binary")
    apart = exact_dedup._told_apart(found, clash)
    assert apart.select("recipe", "apart").distinct().count() == found.select("text_sha256").distinct().count()
    two = spark.createDataFrame([(b"a" * 16, b"x"), (b"a" * 16, b"y"), (b"b" * 16, b"z")], "chunk_hash binary, content binary")
    assert exact_dedup.clashing_hashes(two).count() == 1


def test_cut_places():
    data = np.frombuffer(np.random.default_rng(0).bytes(200_000), np.uint8)
    ends = exact_dedup.cut_places(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= exact_dedup.LARGEST and sizes[:-1].min() >= exact_dedup.SMALLEST
    shifted = exact_dedup.cut_places(np.r_[data[:777], data])
    assert len(set(np.array(shifted) - 777) & set(ends)) > 0.8 * len(ends)
    assert exact_dedup.cut_places(np.zeros(50_000, np.uint8))[-1] == 50_000 and exact_dedup.cut_places(data[:0]) == []
