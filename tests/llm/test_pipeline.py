import base64

import corpus_pipeline as P
import plain
import public_tokenizers
import pytest
import tiktoken

from gaugeline.llm import line_dedup, mixture
from gaugeline.sources.tables import fresh_path


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tables):
    """Rows before and after every stage."""
    docs, out = tables["documents"], []
    for name, stage in P.STAGES:
        path = fresh_path(spark, f"test-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_columns(tables, stages):
    for name, (_, after) in list(stages.items())[:-1]:
        assert after.columns == tables["documents"].columns, name
        assert after.where("n_chars != length(text)").count() == 0


def test_quality_drops_only_rejected(tables, stages):
    before, after = stages["quality_rules"]
    kept = {r.doc_id for r in after.collect()}
    labels = {r.doc_id: r.quality for r in tables["labels"].collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    measured = {d: plain.quality(t) for d, t in texts.items()}
    failed = {d for d, m in measured.items() if m[0] < 20 or 100 * m[4] > 30 * m[0]}
    assert not kept & failed
    good = {d for d, q in labels.items() if q == 1 and d in texts} - failed
    assert len(good & kept) >= 0.97 * len(good)


def test_lines(stages):
    before, after = stages["line_dedup"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    want = {}
    for (doc, _), (_, deleted, left) in zip(rows, plain.lines_deleted([t for _, t in rows], line_dedup.MIN_WORDS), strict=True):
        if not deleted or plain.words(left):
            want[doc] = left
    assert {r.doc_id: r.text for r in after.collect()} == want


def test_near_duplicates(stages):
    before, after = stages["ngram_join"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    sets = [plain.grams(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = plain.classes(len(rows), pairs)
    assert {r.doc_id for r in after.collect()} == {rows[i][0] for i in range(len(rows)) if want[i] == i}


def test_mixture(stages):
    before, after = stages["mixture"]
    sizes, taken = {}, {}
    for r in before.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(plain.words(r.text))
    for r in after.collect():
        taken[r.source] = taken.get(r.source, 0) + len(plain.words(r.text))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = plain.targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2.0)
    for source, target in zip(names, targets, strict=True):
        assert abs(taken.get(source, 0) - target) <= mixture.BLOCK


def test_ids(stages):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after = stages["byte_bpe"]
    want = sorted((r.doc_id, library.encode_ordinary(r.text), plain.sha(r.text)) for r in before.collect())
    assert sorted((r.doc_id, r.ids, r.decoded_sha256) for r in after.collect()) == want


def test_run(spark, sf_dir, stages):
    assert sorted(map(str, P.run(spark, sf_dir).collect())) == sorted(map(str, stages["byte_bpe"][1].collect()))


def test_empty_documents(spark, tmp_path, tables):
    for name in ("documents", "labels"):
        tables[name].limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
