"""The pipeline's stages in turn, each against a plain version over its own input."""

import os
import re
from collections import Counter, defaultdict

import corpus_pipeline
from tablewright.llm.queries import END_ID
from tests.llm import brute

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, found = docs.columns, {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = found[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
    start, language, exact, near, mixed = (
        rows_of(found[k]) for k in ("", "language", "exact_dedup", "near_dedup", "mixing")
    )
    assert sorted(language) == sorted(r for r in start if any(c.isalpha() for c in r[1] or ""))

    groups = defaultdict(list)
    for d, t, s in language:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), d, t, s))
    assert sorted(exact) == sorted(min(g)[1:] for g in groups.values())

    keep = {d for d, _, root in brute.jaccard_components([(d, t) for d, t, _ in exact]) if d == root}
    assert sorted(near) == sorted(r for r in exact if r[0] in keep)

    sizes = {d: len(brute.words(t)) for d, t, _ in near}
    copies = Counter(d for d, _, _ in mixed)
    assert set(mixed) <= set(near) and max(copies.values()) <= 2
    taken, size, largest = Counter(), Counter(), Counter()
    for d, _, s in near:
        taken[s] += copies[d] * sizes[d]
        size[s] += sizes[d]
        largest[s] = max(largest[s], sizes[d])
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    level, capped = 0.0, set()
    while True:  # raise capped sources to their cap until none of the others is above
        free = set(size) - capped
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)) / sum(weights[s] for s in free)
        above = {s for s in free if level * weights[s] > 2 * size[s]}
        if not above:
            break
        capped |= above
    for s in size:
        target = 2 * size[s] if s in capped else level * weights[s]
        assert abs(taken[s] - target) <= largest[s]

    ids = dict(zip([d for d, _, _ in near], brute.token_ids([t for _, t, _ in near]), strict=True))
    pieces = found["packing"].collect()
    assert sum(p.length for p in pieces) == sum(n * len(ids[d]) for d, n in copies.items())
    by_sequence = defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == brute.crc(ids[p.doc_id][p.start : p.start + p.length])
        by_sequence[p.sequence_id].append(p)
    for parts in by_sequence.values():
        assert all(p.offset == sum(q.length for q in parts if q.offset < p.offset) for p in parts)
        total = sum(p.length for p in parts)
        assert total <= 4096 and total & (total - 1) == 0
    assert END_ID == 2
