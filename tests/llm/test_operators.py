"""Corpus operators against brute force on small fixtures, awkward rows included."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, components, fingerprints, near_dup, packing, pii, piece_codec, quality, sharding, token_counts, url_rules

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, score string, size string, _text string, sketch int"
WORDS = "the of and house river stone light green summer winter market garden window bridge".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (f"{rng.randrange(60)}" if rng.random() < 0.5 else "") for _ in range(n))


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in rows], DOCS)


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, prose(1, 40)), (6, prose(1, 40)), (6, prose(1, 40)), (None, prose(2, 30)), (7, "a" * 20_000), (8, prose(3, 20_000)),
    (9, "Ünïcödé 😀 中文  two  spaces\r\n<|endoftext|> end"), (10, "1 " * 5_000), (11, prose(1, 39) + " other"),
]


def test_every_operator_takes_awkward_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, None)], "doc_id long, quality int")
    for rows in (AWKWARD, []):
        d = docs(spark, rows)
        model = quality.fit(d, labels)
        assert quality.score_documents(d, model).where("score between 0 and 1").count() == len(rows)
        assert fingerprints.compare_with_next(d).count() == len(rows)
        assert fingerprints.fingerprints(d).count() == len(rows)
        assert sharding.shard_records(d, shards=3, slots=64).count() == len(rows)
        found = pii.fit(d)
        assert pii.find_personal_data(d, found).count() == len(rows)
        assert pii.redact(d, found).columns == d.columns and pii.redact(d, found).count() == len(rows)
        assert quality.keep_good(d, model, threshold=0.0).count() == len(rows)
        assert token_counts.count_tokens(d, BPE).count() == len(rows)
        assert near_dup.near_duplicates(d).count() == len(rows)
        assert piece_codec.round_trip(d, PIECES).count() == len(rows)
        packed = packing.pack_documents(d, BPE)
        assert packed.select("doc_id").distinct().count() == len({i for i, _ in rows})
        pages = d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), "score")
        assert url_rules.judge_urls(pages, url_rules.OWN_RULES).count() == len(rows)


def test_fingerprints_of_halves(spark):
    rows = [(i, prose(i, 30 + 7 * i)) for i in range(40)] + [(100, prose(3, 51)), (101, None)]
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs(spark, rows).repartition(5)).collect()}
    order = sorted(rows, reverse=True)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        edited = fingerprints.edited_text(text, following)
        own = fingerprints.signatures(text)
        assert got[i]["n_chars"] == len(text) == len(edited) or len(following) < len(text) // 2
        assert got[i]["near_edited"] == fingerprints.likeness(own, fingerprints.signatures(edited))
        assert got[i]["near_next"] == fingerprints.likeness(own, fingerprints.signatures(following))
    assert got[3]["fingerprint"] == got[100]["fingerprint"]


def test_near_pairs_of_fingerprints_lose_none(spark):
    rows = [(i, " ".join(prose(i // 4, 80).split()[: 80 - 3 * (i % 4)])) for i in range(60)]
    prints = fingerprints.fingerprints(docs(spark, rows))
    sets = {i: fingerprints.signatures(t) for i, t in rows}
    reps = {}
    for i in sorted(sets):
        reps.setdefault(sets[i], i)
    want = {(a, b) for a in reps.values() for b in reps.values() if a < b and fingerprints.likeness(sets[a], sets[b]) >= 0.6}
    assert want and {(r["a"], r["b"]) for r in fingerprints.near_pairs(prints, 0.6).collect()} == want


def test_shards_are_even_and_the_map_keeps_versions(spark, tmp_path):
    d = docs(spark, [(i, "x" * (i * 37 % 900)) for i in range(1500)])
    got = sharding.shard_records(d, shards=7, slots=512, maps=str(tmp_path)).toPandas()
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() < 0.02 * loads.mean()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert all(r.text_crc32 == zlib.crc32(b"x" * (r.doc_id * 37 % 900)) for r in got.itertuples())
    first, last = sharding.SlotMap.load(spark, str(tmp_path), 1), sharding.SlotMap.load(spark, str(tmp_path))
    assert (first.version, last.version) == (1, 2) and first == sharding.SlotMap.initial(7, 512)
    moved = sum(a != b for a, b in zip(first.shard_of, last.shard_of))
    assert moved < 0.5 * 512
    fewer = last.rebalanced({s: 1 for s in range(512)}, shards=5)
    assert set(fewer.shard_of) == set(range(5)) and fewer.version == 3


def test_quality_rules_separate_held_out_documents(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad, text = i % 4 == 0, prose(i, 60)
        rows.append((i, " ".join(w + rng.choice(["***", "%%%"]) for w in text.split()) if bad else text))
        labels.append((i, int(not bad)))
    d, known = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(d, known)
    scored = quality.score_documents(d, model).join(known, "doc_id").where("held_out").toPandas()
    assert len(scored) > 60 and ((scored.score >= 0.7) == (scored.quality == 1)).all()
    assert model.described() and quality.keep_good(d, model).toPandas().shape == (300, 6)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rng = random.Random(9)
    bits = ["a@b.co", "x_y@d-e.f.g", "@", ".", "..", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+", "12", " ", "-", "é", "😀", "(at)", "0001.02.3.4"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 30)))) for i in range(400)] + [(1000, "1.2.3.4 " * 700), (1001, "9" * 3000), (1002, "a@" + "b." * 2000 + "c")]
    never = pii.PiiModel((), (), (2.0,) * 4)
    for r in pii.with_spans(docs(spark, rows), never).select("text", "_base").collect():
        assert [(c["start"], c["kind"], c["end"]) for c in r["_base"]] == base_spans(r["text"])
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, [(1, "mail a@b.co or +1 (988) 555-2485!"), (2, None), (3, "none")]), never).collect()}
    assert clean == {1: "mail [EMAIL] or [PHONE]!", 2: None, 3: "none"}


def private_rows(n, ips=10):
    """Texts with base spans, of which one in ``ips`` holds an address, and structurally wrong numbers."""
    rng, rows = random.Random(12), []
    for i in range(n):
        card = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card += next(c for c in "0123456789" if luhn(card + c))
        bits = [f"{rng.choice(WORDS)}.{i}@mail{i % 7}.example.com", f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", card, f"19{i % 90 + 10}-0{i % 9 + 1}-1{i % 9}", f"{i}.{i + 12345678}"]
        bits += [f"4111 1111 1111 {1112 + i % 5}", f"00:1A:2B:3C:4D:{i % 90 + 10}"] + ([f"10.{i % 250}.7.{i % 99}", f"300.1.1.{i}"] if i % ips == 0 else [])
        rows.append((i, " ".join(f"{prose(i, 3)} {b}, " for b in bits)))
    return rows


PLANTED = ["ann.lee (at) mail3.example (dot) com", "(988) 555-2485", "988-555-2485", "2001:db8:85a3:0:0:8a2e:370:7334", "4111.1111.1111.1111"]
WRONG = ["2024-01-15", "3.14159265", "4111.1111.1111.1112", "00:1A:2B:3C:4D:5E"]


def test_spans_without_their_base_mark_are_found(spark):
    rows = private_rows(300) + [(1000 + i, f"garden river {s}, house") for i, s in enumerate(PLANTED + WRONG)]
    d = docs(spark, rows)
    got = {r["doc_id"] - 1000: r["text"] for r in pii.redact(d, pii.fit(d)).where("doc_id >= 1000").collect()}
    want = [f"garden river [{k}], house" for k in ("EMAIL", "PHONE", "PHONE", "IP", "CARD")] + [f"garden river {s}, house" for s in WRONG]
    assert [got[i] for i in range(len(want))] == want


def test_thresholds_follow_from_all_documents(spark):
    ids = [r["id"] for r in spark.range(20_000).orderBy(F.xxhash64("id").desc()).limit(40).collect()]  # far from the ids that hash lowest
    rare = dict(zip(ids, (t for _, t in private_rows(40, ips=1))))
    planted = [(20_000 + i, f"garden river {s}, house") for i, s in enumerate(PLANTED)]
    model = pii.fit(docs(spark, [(i, rare.get(i, "none")) for i in range(20_000)]))
    assert model.trees and all(t <= 1.0 for t in model.thresholds)
    got = [r["spans"].split(":")[0] for r in pii.find_personal_data(docs(spark, planted), model).orderBy("doc_id").collect()]
    assert got == ["email", "phone", "phone", "ip", "card"]


def test_nearest_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 32))
    x = (centres[rng.integers(0, 12, 900)] + 0.5 * rng.normal(size=(900, 32))).astype(np.float32)
    x[400:700] = x[400]  # one vector of a third of all rows
    rows = [(i, v.tolist(), "q") for i, v in enumerate(x)] + [(900, None, ""), (950, [0.0] * 32, ""), (1000, [float("nan")] * 32, ""), (1050, [1.0, None] * 16, ""), (1100, [1.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string")
    got = ann.nearest_neighbours(df, lambda key: key % 50 == 0).toPandas()
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 900, 50):
        own = got[got.query_id == q].sort_values("rank")
        s = y @ y[q]
        s[q] = -9
        want = [i for _, i in sorted(zip(-s.round(12), range(900)))[:5]]
        hits += len(set(want) & set(own.vec_id))
        assert len(own) == 5 and q not in set(own.vec_id)
        assert all(math.isclose(r.score, s[r.vec_id], abs_tol=1e-12) for r in own.itertuples())
    assert set(got.query_id) == set(range(0, 900, 50)) and hits >= 0.95 * 90
    assert got[got.query_id == 450].sort_values("rank").vec_id.tolist() == [400, 401, 402, 403, 404]


def test_url_rules(spark):
    rules = (url_rules.host_path_rule("allow", "org"), url_rules.host_path_rule("block", "a.org", "/x/1")) + url_rules.OWN_RULES
    urls = ["http://A.org/x/12?q", "https://b.a.org/x/1", "http://a.org", "http://norg/x/", "ftp://spam-farm.net/a#b", "no scheme", None, "http://c.net/casino/1", "http://c.net/casinos/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge_urls(df, rules).collect()}
    assert [got[i] for i in range(9)] == [
        ("a.org/x/1", "block"), ("a.org/x/1", "block"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow"),
    ]


def test_token_counts_packing_and_pieces_equal_the_libraries(spark):
    import sentencepiece

    rows = [(i if i is not None else -1, t) for i, t in AWKWARD if i != 6] + [(20 + i, prose(i, 900)) for i in range(6)]
    d, texts = docs(spark, rows).repartition(3), dict(rows)
    bpe = token_counts.tokenizer(BPE)
    ids = {i: bpe.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    for head in (0, 50, token_counts.HEAD_ROWS):  # all, most or none of the pre-tokens go through the join
        got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(d, BPE, head_rows=head).collect()}
        assert got == {i: (len((t or "").encode()), len(ids[i])) for i, t in rows}
    pieces = packing.pack_documents(d, BPE).toPandas()
    for i, own in pieces.groupby("doc_id"):
        assert np.frombuffer(b"".join(own.sort_values("start").ids), "<u4").tolist() == [*ids[i], 1]
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 2048
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = piece_codec.encode_documents(d, PIECES)
    for r in encoded.collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == model.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
    back = {r["doc_id"]: r["text"] for r in piece_codec.decode_documents(encoded, PIECES).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows)


def test_level_packer_minimises_the_sum_of_squares():
    rng, packer = random.Random(1), packing.LevelPacker(64)
    counts = [0] * 65
    for _ in range(500):
        size = rng.randrange(1, 64)
        costs = {}
        for level in [0] + [v for v in range(1, 65 - size) if counts[v]]:
            after = list(counts)
            after[level] -= level > 0
            after[level + size] += level + size < 64
            costs[level] = sum(c * c for c in after)
        assert costs[packer.level_for(size)] == min(costs.values())
        list(packer.add(0, b"\0\0\0\0" * size))
        counts = packer.counts.tolist()


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_by_brute_force(spark, seed):
    rng, rows = random.Random(seed), []
    for g in range(12):
        base = prose(100 * seed + g, rng.choice([6, 40, 150, 600])).split()
        for _ in range(rng.choice([1, 2, 25])):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(own) // 30))):
                own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    passage = prose(7, 60)
    rows += [(len(rows) + i, passage + " " + prose(1000 + i, 20)) for i in range(30)]
    rows += [(500 + i, rows[3][1]) for i in range(40)] + [(600, None), (601, ""), (602, "two words"), (603, "TWO  words")]
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs(spark, rows).repartition(4)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == root
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (root[i] == i) for i in sets)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (300, 301)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, **{200 + i: 100 for i in range(50)}, 300: 300, 301: 300}


def test_components_of_light_and_heavy_nodes(spark):
    links = [(2 * i, 2 * i + 1) for i in range(1500)] + [(90_000, 10_000 + i) for i in range(400)] + [(10_007, 9_999)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{2 * i + j: 2 * i for i in range(1500) for j in (0, 1)}, **{n: 9_999 for n in (9_999, 90_000, *range(10_000, 10_400))}}


def test_long_pre_tokens_are_counted_by_their_digest(spark):
    longs = ["=" * 64, "=" * 65, " " + "ab" * 40, "ü😀" * 50, "x" * 3_000]
    rows = [(i, " ".join(longs[j % 5] for j in range(i, i + 4 + i % 3))) for i in range(60)]
    d, bpe = docs(spark, rows).repartition(3), token_counts.tokenizer(BPE)
    want = {i: len(bpe.encode(t, add_special_tokens=False).ids) for i, t in rows}
    for head in (0, 2, token_counts.HEAD_ROWS):
        assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(d, BPE, head_rows=head).collect()} == want
    keys = spark.createDataFrame([(t,) for t in longs], "t string").select("t", token_counts.key_column("t").alias("k")).collect()
    assert all(r["k"] == token_counts.key_of(r["t"]) and len(r["k"]) <= 65 for r in keys)


def test_packed_ids_are_the_librarys_while_few_words_are_remembered(spark):
    """Batches with more new words than are remembered, even and uneven texts mixed; each new word is computed in one call."""
    from tidemark.llm.common import Memo

    calls = []
    memo = Memo(lambda key: calls.append([key]) or key * 2, 10)
    assert memo.all_of(keys := [f"w{i % 40}" for i in range(100)], lambda new: calls.append(new) or [k * 2 for k in new]) == [k * 2 for k in keys]
    assert [len(c) for c in calls] == [40] and len(memo) <= 10 and len(memo.old) <= 40
    rng = random.Random(5)
    words = ["data", "été", "Zug,", "don't", "日本語", "x" * 70, "12.5", "<|endoftext|>", "naïve—so", "😀!"]
    texts = [sep.join(rng.choice(words) + str(rng.randrange(400)) for _ in range(rng.randrange(0, 60))) for sep in (" ", "\n", "  ", " \n", "\t") for _ in range(40)]
    texts += ["", " ", "\n", " a", "a ", "\na", "a\nb c"]
    own = packing.tokenizer(BPE)
    packed = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BPE, remembered=50).toPandas()
    for key, rows in packed.groupby("doc_id"):
        ids = b"".join(rows.sort_values("start").ids)
        assert list(np.frombuffer(ids, "<u4")) == [*own.encode(texts[key], add_special_tokens=False).ids, 1]
    assert packed.doc_id.nunique() == len(texts)
