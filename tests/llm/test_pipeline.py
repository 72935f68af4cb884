"""The corpus pipeline against a brute-force version of its stages."""

import hashlib
import math
import re

from pyspark.sql import functions as F

import corpus_pipeline as C
from sheafwork.llm import pii, unigram

from .helpers import AWKWARD, clusters, plain_documents
from .test_simhash import plain_fingerprint
from .test_texts import plain_kept, plain_segmentation, plain_spans
from .test_tokenizers import check_packing, log_sums


def rows_of(frame):
    return [tuple(r) for r in frame.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def fixture(spark):
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    return plain_documents(spark, [*AWKWARD, *((r["doc_id"] + 1000, r["text"], r["lang"]) for r in some)])


def plain_language(model, text):
    """The most probable language and its share, by sums in logarithms over all segmentations of each word."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    if not words:
        return "und", 0.0
    total, floor = [0.0] * len(model.languages), (unigram.FLOOR,) * len(model.languages)
    for k in range(len(model.languages)):
        known = {}
        for word in words:
            if word not in known:
                w = "▁" + word
                arcs = lambda a, w=w, k=k: [(b, model.pieces.get(w[a:b], floor)[k]) for b in range(a + 1, min(len(w), a + 16) + 1) if b == a + 1 or w[a:b] in model.pieces]
                known[word] = log_sums(arcs, len(w))[-1]
            total[k] += known[word]
    scale = min(1.0, 25 / len(words))
    best = max(range(len(total)), key=lambda k: (total[k], -k))
    return model.languages[best], 1 / sum(math.exp((x - total[best]) * scale) for x in total)


def plain_first(rows):
    """One row of each group of texts whose fingerprints link, the smallest by id and then by digest."""
    prints = [plain_fingerprint(r[1]) for r in rows]
    root = clusters(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(root[k], []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())) for g in groups.values()]


def plain_redacted(model, text):
    base = plain_spans(text)
    more = [x for a, b in pii.regions(text) for x in plain_segmentation(text, a, b, model)]
    spans = sorted([*base, *(x for x in more if not any(x[0] < e and s < x[1] for s, e, _ in base))], key=lambda x: (x[0], pii.KINDS.index(x[2])))
    out = text
    merged = []
    for s, e, kind in spans:
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]), merged[-1][2])
        else:
            merged.append((s, e, kind))
    for s, e, kind in reversed(merged):
        out = out[:s] + f"[{kind.upper()}]" + out[e:]
    return out


def plain_stage(name, docs, before):
    """What a stage makes of the rows ``before``; models are trained on ``docs``, which hold them."""
    if name == "quality_rules":
        return [r for r in before if plain_kept(r[1])]
    if name == "language_id":
        model = unigram.train_language_model(docs)
        told = [plain_language(model, r[1] or "") for r in before]
        return [r for r, (lang, score) in zip(before, told, strict=True) if lang != "und" and score >= C.LEAST_LANGUAGE_SCORE]
    if name == "near_duplicates":
        return plain_first(before)
    model = pii.train_segment_model(docs)
    return [(i, t, lang, source, len(t)) for i, t, lang, source in ((i, plain_redacted(model, t), lang, source) for i, t, lang, source, _ in before)]


def test_stages_and_run_equal_brute_force(spark, tmp_path):
    docs = fixture(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in C.STAGES[:-1]:
        before = rows_of(docs)
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        want = plain_stage(name, docs, before)
        docs = spark.read.parquet(str(tmp_path / name))
        assert sorted(map(str, rows_of(docs))) == sorted(map(str, want)), name
        assert name in ("personal_data", "language_id") or len(want) < len(before), name
    texts = [(r[0], r[1]) for r in rows_of(docs)]
    assert not any(pii.base_spans(t) for _, t in texts)
    check_packing(C.STAGES[-1][1](spark, docs, "").collect(), texts, 2048)
    found = C.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    bins, tokens = check_packing(found.collect(), texts, 2048)
    assert bins <= 1.05 * -(-tokens // 2048)


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").where("size(split(trim(text), '[ \\n]+')) >= 50").select("doc_id")
    kept = C.STAGES[1][1](spark, C.STAGES[0][1](spark, docs, ""), "")
    assert good.join(kept, "doc_id", "left_anti").count() == 0


def test_empty_table(spark):
    docs = plain_documents(spark, [])
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, "").count() == 0
    assert C.STAGES[-1][1](spark, docs, "").count() == 0


def test_clashing_columns_pass_through(spark):
    names = ["_t", "_q", "_w", "_kept", "_base_failed", "kept_id", "row", "_lang_pred", "component_id", "fp", "raw"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = {r["doc_id"] for r in C.STAGES[2][1](spark, C.STAGES[1][1](spark, C.STAGES[0][1](spark, docs, ""), ""), "").collect()}
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    for stage_name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns[5:] == names, stage_name
    rows = docs.collect()
    assert {r["doc_id"] for r in rows} == plain
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    assert C.STAGES[-1][1](spark, docs, "").count() >= len(rows)


def test_one_row_of_each_near_duplicate_group_stays(spark):
    """Rows without an id, and rows that repeat an id with another text, are judged by their own text."""
    texts = [" ".join(f"{w}{k}" for k in range(60)) for w in ("apple", "birch", "cedar", "daisy", "elder")]
    a, b, c, d, e = texts
    rows = [(None, a, "en"), (None, b, "en"), (None, b, "en"), (None, c, "en"), (3, c, "en"), (5, c, "en"), (5, d, "en"), (9, d, "en"), (9, e, "en"), (9, e, "en"), (2, e, "en")]
    out = C.near_duplicates(spark, plain_documents(spark, rows), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(str, [(None, a), (None, b), (3, c), (5, d), (2, e)]))


def test_without_a_learned_language_texts_stay(spark):
    """No labels; labels on rows without a usable id only (crc32 of "2" mod 3 is 1); labels on texts without letters."""
    texts = [(1, "some plain text"), (2, "noch ein Text"), (None, "a third one"), (7, " 12 34 "), (8, "5"), (9, "6")]
    for langs in ([None] * 6, [None, "en", "de", None, None, None], [None] * 3 + ["de", "en", "fr"]):
        docs = plain_documents(spark, [(i, t, lang) for (i, t), lang in zip(texts, langs, strict=True)])
        assert sorted(str(r["doc_id"]) for r in C.language_id(spark, docs, "").collect()) == ["1", "2", "None"]
