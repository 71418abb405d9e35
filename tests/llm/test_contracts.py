"""The registered queries' result columns, and the pipeline's stages, against plain Python."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from test_operators import AWKWARD, base_spans, docs, private_rows, prose

import corpus_pipeline
from tidemark.llm import fingerprints, quality, queries

ROWS = [(i if i is not None else -5, t) for i, t in AWKWARD if i != 6] + [(30 + i, prose(i, 60)) for i in range(20)] + private_rows(0)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables of a small folder, awkward rows among them."""
    path = str(tmp_path_factory.mktemp("tables"))
    table = docs(spark, ROWS).withColumns({"lang": F.lit("en"), "source": F.concat(F.lit("s"), F.col("doc_id") % 3), "n_chars": F.length("text").cast("long")})
    table.select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in ROWS], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1_columns(spark, folder):
    got, order = by_id(queries.op1_spotsigs(spark, folder)), sorted(ROWS, key=lambda r: -r[0])
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), sha(edited))
        sets = [set(filter(None, s.split(","))) for s in (got[i]["fingerprint"], got[i]["edited_fingerprint"])]
        both, either = len(sets[0] & sets[1]), len(sets[0] | sets[1])
        assert got[i]["near_edited"] == pytest.approx(both / either if either else float(got[i]["near_edited"])) and 0 <= got[i]["near_next"] <= 1


def test_op2_columns(spark, folder):
    got = by_id(queries.op2_virtual_slots(spark, folder))
    for i, text in ROWS:
        raw = (text or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"], got[i]["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    for s in range(40):
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got.values())))


def statistics(text):
    """The statistics of one text, word by word."""
    text = text or ""
    words, lines, n = re.split(r"[ \t\n\x0b\f\r]+", text.strip(" ")), text.split("\n"), len(text)
    letters, upper, digits = (sum(regex.fullmatch(p, c) is not None for c in text) for p in (r"\p{L}", r"\p{Lu}", "[0-9]"))
    odd = sum(regex.fullmatch(r"[\p{L}\p{N} \t\n\x0b\f\r.,;:'\"()-]", c) is None for c in text)
    again = sum(a == b for a, b in zip(words, words[1:]))
    return (
        math.log1p(len(words)) if n else 0.0, n / len(words), letters / max(n, 1), upper / max(letters, 1), odd / max(n, 1), digits / max(n, 1), len(set(words)) / len(words) if n else 0.0,
        again / len(words), len(words) / len(lines) if n else 0.0, 1 - len(set(lines)) / len(lines),
    )


def test_op3_statistics_and_scores_are_those_of_plain_python(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    found = by_id(table.select("doc_id", quality.statistics().alias("s")))
    for i, text in ROWS:
        assert tuple(found[i]["s"]) == pytest.approx(statistics(text)), text
    rules = (((6, "<=", 0.9), (0, ">", 1.0)), ((7, ">", 0.0),), ((2, ">", 0.5),), ((9, ">", 0.1),))
    model = quality.RuleEnsemble(rules, (1.5, -2.0, 0.7, -0.3), 0.1)
    for r in quality.score_documents(table, model).collect():
        s = statistics(dict(ROWS)[r["doc_id"]])
        logit = 0.1 + sum(w for rule, w in zip(rules, model.weights) if all((s[f] <= c) if side == "<=" else (s[f] > c) for f, side, c in rule))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-logit))) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    got = by_id(queries.op3_rule_ensemble(spark, folder))
    assert set(got) == {i for i, _ in ROWS} and all(r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_a_filter_on_the_score_reads_each_text_once(spark):
    """One text of 100,000 words: filtering by the score costs what scoring costs."""
    import time

    table = docs(spark, [(i, prose(i, 100_000)) for i in range(4)]).select("doc_id", "text").repartition(4).cache()
    table.count()
    model = quality.RuleEnsemble((((7, ">", 0.01), (6, "<=", 0.5)), ((9, "<=", 0.5),)), (1.0, 2.0), 0.0)
    took = []
    for df in (quality.score_documents(table, model), quality.keep_good(table, model)) * 2:
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - start)
    assert took[3] < 1.5 * took[2] + 1


def test_op4_columns(spark, folder):
    kinds = ("email", "ip", "card", "phone")
    for r in queries.op4_candidate_boosting(spark, folder).collect():
        base = base_spans(dict(ROWS)[r["doc_id"]] or "")
        spelled = [f"{kinds[k]}:{s}:{e}" for s, k, e in base]
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[1] == i for x in base) for i in range(4)] and r["base_sha256"] == sha(",".join(spelled))
        assert set(spelled) <= set(r["spans"].split(",") if r["spans"] else [])


def test_op7_op9_op10_columns(spark, folder):
    import sentencepiece
    import tokenizers

    bpe, pieces = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counts, codes = by_id(queries.op7_token_counts(spark, folder)), by_id(queries.op10_prefix_table(spark, folder))
    packed = queries.op9_sum_of_squares(spark, folder).toPandas()
    for i, text in ROWS:
        own = [*bpe.encode(text or "", add_special_tokens=False).ids, 1]
        assert (counts[i]["n_bytes"], counts[i]["n_tokens"], counts[i]["over_limit"]) == (len((text or "").encode()), len(own) - 1, len(own) - 1 > 1024)
        cut = packed[packed.doc_id == i].sort_values("start")
        assert all(zlib.crc32(np.asarray(own[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(own) for r in cut.itertuples()) and cut.length.sum() == len(own)
        ids = pieces.encode(text or "", add_bos=True, add_eos=True)
        assert (codes[i]["n_tokens"], codes[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert codes[i]["decoded_sha256"] == sha(pieces.decode(ids))


# -- the pipeline's stages ----------------------------------------------------------------------


def stage_input(spark, rows):
    """Documents with repeated rows and ids, a null id, and columns that a stage must leave out."""
    table = docs(spark, rows).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "kept": F.lit(1), "component_id": F.lit(2)})
    return table.repartition(3)


def texts(df):
    assert df.columns == list(corpus_pipeline.COLUMNS)
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_quality_stage_keeps_what_scores_well(spark, tmp_path):
    rows = [(i, prose(i, 60) if i % 3 else " ".join(["spam!!!"] * 30 + ["%%%"] * 30)) for i in range(240)]
    rows += [(i, t) for i, t in AWKWARD if i is None or i > 3] + rows[:2]
    labels = [(i, int(i % 3 > 0)) for i in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    table = stage_input(spark, rows).where("doc_id IS NULL OR doc_id < 2000")
    kept = texts(corpus_pipeline.quality_filter(spark, table, str(tmp_path)))
    model = quality.fit(table, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = quality.score_documents(table.select("doc_id", "text"), model).collect()
    assert len(kept) == sum(r["score"] >= 0.7 for r in scores)
    assert {i for i, t in kept if t and t.startswith("spam")} == set() and {i for i in range(12, 240) if i % 3} <= {i for i, _ in kept}


def test_near_duplicate_stage_keeps_one_row_of_a_group(spark):
    long = prose(1, 200)
    rows = [(3, long), (4, long), (4, long), (5, long + " more"), (6, prose(2, 200)), (6, prose(2, 200)), (7, None), (7, None), (8, ""), (None, prose(3, 50)), (None, prose(3, 50)), (9, "two words"), (10, "two words")]
    got = texts(corpus_pipeline.near_duplicates(spark, stage_input(spark, rows), ""))
    want = [(3, long), (6, prose(2, 200)), (7, None), (8, ""), (9, "two words")] + [(None, prose(3, 50))] * 2
    assert got == sorted(want, key=str)
    assert texts(corpus_pipeline.near_duplicates(spark, stage_input(spark, []), "")) == []


def test_personal_data_stage_leaves_no_base_span(spark):
    rows = [(i, t) for i, t in private_rows(120)] + [(500, None), (501, ""), (502, "no data"), (502, "no data"), (None, "mail a.b@c.example now")]
    df = corpus_pipeline.personal_data(spark, stage_input(spark, rows), "")
    got = texts(df)
    assert len(got) == len(rows) and all(not base_spans(t or "") for _, t in got)
    assert (None, "mail [EMAIL] now") in got and got.count((502, "no data")) == 2 and (500, None) in got
    assert df.where("text IS NOT NULL AND n_chars != length(text)").count() == 0


def test_packing_stage_and_the_whole_run(spark, folder):
    import tokenizers

    bpe = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, t) for i, t in AWKWARD if i is not None and i != 6]
    packed = corpus_pipeline.packed_sequences(spark, stage_input(spark, rows), "").toPandas()
    for i, text in rows:
        own = packed[packed.doc_id == i].sort_values("start")
        assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == [*bpe.encode(text or "", add_special_tokens=False).ids, 1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "packing"]
    assert set(corpus_pipeline.run(spark, folder).select("doc_id").distinct().toPandas().doc_id) <= {i for i, _ in ROWS}


def test_equal_texts_have_equal_fingerprints(spark):
    got = fingerprints.fingerprints(docs(spark, [(1, prose(1, 80)), (2, prose(1, 80)), (3, prose(2, 80))])).collect()
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[1] == prints[2] != prints[3]
