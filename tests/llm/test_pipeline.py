"""The pipeline's stages on a small fixture, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from quillspark.llm import pii, quality  # noqa: E402
from tests.llm.test_operators import brute_components, brute_quality  # noqa: E402


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(11)
    en = [a + b for a in ("the", "wh", "th", "ing", "ough") for b in ("ey", "en", "ought", "er", "is", "ose")]
    fr = [a + b for a in ("le", "qu", "eau", "é", "oi") for b in ("ment", "e", "aux", "ier", "tion", "le")]
    rows = []
    for i in range(60):
        words = en if i % 3 else fr
        t = " ".join(rng.choice(words) for _ in range(rng.randint(60, 200)))
        rows.append((i, t, "en" if i % 3 else "fr", f"src{i % 4}", len(t)))
    t = rows[7][1]
    near = t.split()
    near[20] = "altered"
    extra = [(100, t), (101, " ".join(near)), (102, "short text"), (103, "$$$ &&& " * 80), (104, None), (105, rows[1][1] + " mail x.y@z.org now")]
    rows += [(i, x, "en", "src0", len(x or "")) for i, x in extra]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_stages(spark, stored):
    path, rows = stored
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = {i: t for i, t, *_ in rows}
    by_name = dict(pipeline.STAGES)
    assert list(by_name) == ["quality_rules", "language_id", "near_duplicates", "personal_data", "best_fit_packing"]

    out = by_name["quality_rules"](spark, docs, path)
    assert out.columns == columns
    got = {r.doc_id for r in out.collect()}
    for i, t in kept.items():
        n, _, _, _, repeated = brute_quality(t)
        if n < 50 or 100 * repeated > 50 * n:
            assert i not in got
    assert got == {r.row.doc_id for r in quality.judge(docs).where("kept").collect()} and 103 not in got and 7 in got

    out = by_name["language_id"](spark, out, path)
    assert out.columns == columns and {r.doc_id for r in out.collect()} == got  # clean documents stay

    parts = brute_components([(i, kept[i]) for i in sorted(got)])
    out = by_name["near_duplicates"](spark, out, path)
    left = {r.doc_id for r in out.collect()}
    assert out.columns == columns and left == {c for _, c in parts.values()} and 100 not in left and 7 in left

    out = by_name["personal_data"](spark, out, path)
    clean = {r.doc_id: r for r in out.collect()}
    assert out.columns == columns and set(clean) == left
    assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in clean.values())

    packed = by_name["best_fit_packing"](spark, out, path).collect()
    assert {r.doc_id for r in packed} == left
    used = {}
    for r in packed:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 4096


def test_run(spark, stored):
    """The whole run against plain versions of its stages: which documents are left,
    their sanitised texts' ids, and sequences without gaps."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    path, rows = stored
    texts = {i: t for i, t, *_ in rows}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    good = {r.row.doc_id for r in quality.judge(docs).where("kept").collect()}
    parts = brute_components([(i, texts[i]) for i in sorted(good)])
    left = {c for _, c in parts.values()}
    clean = {r.doc_id: r.text for r in pii.sanitize(docs.where(F.col("doc_id").isin(*left))).collect()}
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*encode.encode(clean[i], add_special_tokens=False).ids, 1] for i in left}
    got = pipeline.run(spark, path).collect()
    assert {(r.doc_id, r.piece) for r in got} == {(i, 0) for i in left}  # these texts are short
    used = {}
    for r in got:
        ids = list(memoryview(bytes(r.ids)).cast("I"))
        assert ids == want[r.doc_id] and len(ids) == r.length and r.start == 0
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in used.values():
        ends = [o + n for o, n in sorted(spans)]
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(used) <= -(-sum(map(len, want.values())) // 4096) + 1


def test_stages_of_odd_tables(spark, stored):
    """Empty tables, nulls in every column, repeated rows, ties and columns with
    the operators' own names: each stage keeps columns and clean rows."""
    path, rows = stored
    plain = spark.read.parquet(f"{path}/documents.parquet")
    extra = ["row", "uid", "words", "root", "spans", "hilbert", "kept", "lines"]
    odd = plain.unionByName(plain.where("doc_id in (1, 2, 3)"))  # whole rows repeated
    null = spark.createDataFrame([(None,) * len(plain.columns)], plain.schema)
    odd = odd.unionByName(null).unionByName(null)
    for c in extra:
        odd = odd.withColumn(c, F.lit(c) if c != "uid" else F.lit(None).cast("long"))
    for name, stage in pipeline.STAGES:
        none = stage(spark, plain.where("doc_id < 0"), path)
        assert none.count() == 0, name
        out = stage(spark, odd, path)
        got = out.collect()
        if name != "best_fit_packing":
            assert out.columns == odd.columns and all(r["row"] == "row" for r in got), name
        if name == "quality_rules":
            assert sum(r.doc_id == 1 for r in got) == 2 and all(r.doc_id is not None for r in got)
        if name == "near_duplicates":
            assert sum(r.doc_id in (1, 2, 3) for r in got) == 3  # repeated rows are copies
        if name == "personal_data":
            assert len(got) == odd.count()  # nothing is dropped, null texts stay
            assert {r.doc_id for r in got if r.text is None} == {None, 104}
        if name == "best_fit_packing":
            assert sum(r.doc_id is None for r in got) == 2 and all(r.length == 1 for r in got if r.doc_id is None)
