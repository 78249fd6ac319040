"""Each operator against a brute-force version, and on nulls, ties, empty and odd tables."""

import hashlib
import html as entities
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import audio, forest, html, language, lines, packing, registry, secrets, simhash, toxicity, transducer
from tessera.llm.components import connected_components

SF = "/root/testdata/sf0.001"
ODD = [(1, "the cat sat on the mat again"), (1, "the cat sat on the mat again"), (None, None), (2, None), (3, ""), (4, "x" * 300_000), (5, "a\tb\n\nthe cat sat on the mat again"), (None, "é 日本 🙂")]


def frame(spark, rows, names="doc_id long, text string"):
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeats, an empty and a long text, and columns with names the operators use."""
    df = frame(spark, ODD)
    return df.select("*", F.lit("x").alias("line_key"), F.lit(1).alias("key"), F.lit(2).alias("fp"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))


OPERATORS = {
    "packing": packing.best_fit_packing,
    "lines": lines.line_dedup,
    "secrets": secrets.secret_scan,
    "redact": secrets.redact,
    "simhash": simhash.simhash_near_dedup,
    "audio": audio.audio_features,
    "sentencepiece": transducer.sentencepiece_codec,
    "language": lambda d: language.predict_language(d, language.fit_language_model(d)),
    "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.fit_toxicity_model(d, d.select("doc_id", F.lit(0).alias("toxic")))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, odd, name):
    rows = OPERATORS[name](odd).collect()
    assert len(rows) >= len(ODD)
    if name != "packing":
        assert len(rows) == len(ODD)
        ids = lambda of: sorted(map(str, of))
        assert ids(r["doc_id"] for r in rows) == ids(i for i, _ in ODD)
        same = [tuple(r) for r in rows if r["doc_id"] == 1]
        assert same[0] == same[1]
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_odd_rows_have_their_defined_results(spark, odd):
    by = lambda df: {r["doc_id"]: r for r in df.where("doc_id is not null").collect()}
    packed = by(packing.best_fit_packing(odd))
    assert packed[2]["length"] == packed[3]["length"] == 1
    lined = by(lines.line_dedup(odd))
    # the two equal rows are peers, the later line goes, blank lines stay
    assert [(lined[i]["text"], lined[i]["n_lines"], lined[i]["n_removed"]) for i in (1, 2, 3, 5)] == [(ODD[0][1], 1, 0), (None, 0, 0), ("", 1, 0), ("a\tb\n", 3, 1)]
    assert lined[5]["line_key"] == "x" and lined[5]["n_chars"] == 4
    prints = by(simhash.simhash_near_dedup(odd))
    assert prints[2]["fingerprint"] == prints[3]["fingerprint"] == "0" * 16 and prints[2]["component_id"] == prints[3]["component_id"] == 2
    pieces = by(transducer.sentencepiece_codec(odd))
    assert pieces[2]["n_pieces"] == pieces[3]["n_pieces"] == 0 and all(r["exact"] for r in pieces.values())
    media = by(audio.audio_features(odd))
    assert (media[2]["n_bytes"], media[2]["payload_bytes"]) == (0, 192) and media[4]["payload_bytes"] == 300_096
    model = language.fit_language_model(odd)
    spoken = by(language.predict_language(odd, model))
    assert spoken[2]["lang_pred"] == spoken[3]["lang_pred"] == "und" and spoken[1]["lang_pred"] == "en"
    scores = by(toxicity.score_toxicity(odd, toxicity.fit_toxicity_model(odd, odd.select("doc_id", F.lit(None).cast("int").alias("toxic")))))
    assert all(r["predicted"] == 0 and 0 <= r["score"] < 0.3 for r in scores.values())


# 1


def test_packer_takes_the_tightest_bin_and_closes_the_fullest():
    p = packing.BestFitPacker(10, 2)
    assert [p.add(n) for n in (6, 7, 3)] == [(0, 0), (1, 0), (1, 7)]
    assert p.add(9) == (2, 0) and p.add(8) == (3, 0)  # two are open, so the fullest (2) closes
    assert p.add(1) == (3, 8) and p.add(4) == (0, 6)


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


def test_packing_is_whole(spark, docs, texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = packing.op1_best_fit_packing(spark, SF).toPandas()
    assert rows.doc_id.nunique() == len(texts)
    for doc_id, own in rows.sort_values("piece").groupby("doc_id"):
        ids = [*t.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 1024).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    by_sequence = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by_sequence.length.sum() <= 1024).all() and (by_sequence.offset.first() == 0).all()
    for _, own in by_sequence:
        assert own.offset.tolist() == np.concatenate(([0], own.length.cumsum()[:-1])).tolist()
    assert len(by_sequence) <= 1.1 * rows.length.sum() / 1024 + 1


@pytest.mark.parametrize("text", ["", " ", "\n\n\t a  b", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n<|endoftext", "日本語🙂é" * 50, "it's 12345 x" * 9, "a" * 5000, "  İẞ"])
def test_both_tokenizer_files_give_the_same_ids(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    assert packing.encoder()(text) == t.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_a_document(spark):
    r = packing.best_fit_packing(frame(spark, [(1, "a <|endoftext|> b")])).collect()
    assert [(x["length"], x["ids_crc32"]) for x in r] == [(5, zlib.crc32(np.array([64, 220, 50256, 275, 2], "<u4").tobytes()))]


# 2


def test_lines_equal_brute_force(spark, docs):
    rows = [(r["doc_id"], i, line) for r in docs.where("doc_id < 60").collect() for i, line in enumerate((r["text"] or "").split("\n"))]
    rows.sort()
    sets = [set(w for w in re.split(r"[\x20\x09-\x0d]+", line) if w) for _, _, line in rows]
    gone = {
        rows[i][:2]
        for i, a in enumerate(sets)
        if a and any(b and 5 * len(a & b) >= 4 * len(a | b) for b in sets[:i])
    }
    got = lines.line_dedup(docs.where("doc_id < 60")).collect()
    for r in got:
        kept = [line for d, i, line in rows if d == r["doc_id"] and (d, i) not in gone]
        assert r["text"] == "\n".join(kept) and r["n_chars"] == len(r["text"])
    assert gone


def test_lines_of_a_group_of_near_copies(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(70)]
    texts = [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.1 else w for w in base) for _ in range(150)]
    sets = [set(t.split(" ")) for t in texts]
    want = {j for j in range(150) if any(9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) for i in range(j))}
    assert 0 < len(want) < 149
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for share in (2000, 8):
        got = lines.line_dedup(docs, lines.LineDedupConfig(scout_share=share)).where("n_removed > 0").select("doc_id").collect()
        assert {r["doc_id"] for r in got} == want


def test_lines_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(lines.OP2_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = registry.QUERIES["op2_line_dedup"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    for c in want:
        assert (got[c] == want[c]).all(), c


def test_ids_of_other_types_and_short_lines(spark):
    rows = [("b", "one two three four five\nmenu\n\nmenu"), ("a", "one two three four\nread more\nmore read"), ("c", "menu\nmore")]
    got = {r["doc_id"]: r["text"] for r in lines.line_dedup(frame(spark, rows, "doc_id string, text string")).collect()}
    # {one .. four} and {one .. five} have a similarity of 0.8; the blank line stays
    assert got == {"a": "one two three four\nread more", "b": "menu\n", "c": "more"}


def test_a_group_of_near_copies_keeps_its_first(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[:39] + [f"own{i}"])) for i in range(300)]
    out = lines.line_dedup(frame(spark, rows))
    assert out.where("n_removed = 0").select("doc_id").collect() == [(0,)]


def test_both_sides_of_the_second_round_are_exchanged_once(spark, docs, monkeypatch):
    plans, write = {}, lines.materialize

    def planned(df, name):
        if name in ("lines-met", "lines-joined"):
            df.collect()
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(lines, "materialize", planned)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines.line_dedup(docs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("ReusedExchange" in plans[name] for name in ("lines-met", "lines-joined"))


def test_rarity_levels_rise_with_the_count():
    counts = np.random.default_rng(3).geometric(0.01, 1 << 12)
    levels = lines._levels(counts)
    order = np.argsort(counts)
    assert (np.diff(levels[order]) >= 0).all() and levels.min() == 0 and levels.max() == 15
    assert (lines._levels(np.zeros(16, np.int64)) == 0).all()


def test_lines_that_are_nearly_similar_make_no_pairs(spark, monkeypatch):
    # 36 of 41 words in common are a similarity of 36 / 46; the others are the more frequent, so the filters alone admit many of these pairs
    rows = [(i, " ".join([f"w{k}" for k in range(36)] + [f"own{i}x{k}" for k in range(5)])) for i in range(100)]
    rows.append((100, rows[7][1].replace("w0 ", "z ")))
    rows += [(200 + i, "\n".join(" ".join([f"own{i}x{k}"] * 500) for k in range(5))) for i in range(100)]
    counts, write = {}, lines.materialize

    def counted(df, name):
        out = write(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(lines, "materialize", counted)
    monkeypatch.setattr(lines, "_scout_keys", lambda hashes: F.array(F.hash(F.lit(0).cast("long"), hashes[0])))
    got = lines.line_dedup(frame(spark, rows)).where("n_removed > 0").select("doc_id").collect()
    assert [r["doc_id"] for r in got] == [100]
    # the second round's pairs: those of similar lines only
    assert counts["lines-joined"] in ([0], [1])


# 3


def test_forest_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 16))
    near = base[:60] + 0.15 * rng.standard_normal((60, 16))
    ball = base[0] + 0.1 * rng.standard_normal((200, 16))
    x = np.concatenate([base, near, base[:5], ball]).astype("f4")
    rows = [(i, [float(c) for c in v], i % 2 if i < 300 else 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (1004, rows[0][1], None), (1005, [1.0], 0)]
    config = forest.ForestConfig(cell_rows=64, leaf_rows=32, slice_rows=50)
    got = {r["vec_id"]: r for r in forest.embedding_near_dedup(frame(spark, rows, "vec_id long, embedding array<float>, label int"), config).collect()}
    assert len(got) == len(rows)
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[: len(x)]])
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (n <= linked.sum(1)).all() and n.sum() >= 0.9 * linked.sum()
    for i in range(1000, 1006):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[300 + 60]["component_id"] == 0 and not got[300 + 60]["kept"]


@pytest.mark.parametrize("cell_rows", [4096, 1024])
def test_links_of_dense_groups_of_thousands(spark, cell_rows):
    rng = np.random.default_rng(9)
    groups = []
    for cosine, size in ((0.94, 2500), (0.955, 3000), (0.97, 2500)):
        center = rng.standard_normal(64)
        noise = rng.standard_normal((size, 64)) / 8
        groups.append(np.sqrt(cosine) * center / np.linalg.norm(center) + np.sqrt(1 - cosine) * noise)
    x = np.concatenate([*groups, rng.standard_normal((2000, 64))]).astype("f4")
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    links = np.concatenate([(unit[a : a + 1000] @ unit.T >= 0.93).sum(axis=1) - 1 for a in range(0, len(unit), 1000)])
    rows = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = forest.embedding_near_dedup(rows, forest.ForestConfig(cell_rows=cell_rows)).toPandas().sort_values("vec_id")
    assert links.sum() > 10**7 and (got.n_links.to_numpy() <= links).all()
    assert got.n_links.sum() >= (1 - 1e-6) * links.sum()


def test_recall_over_many_levels(spark):
    """Trees of several fitted levels, cells that are fitted again, and tasks that deal parts of a label."""
    rng = np.random.default_rng(21)
    base = rng.standard_normal((6000, 24))
    near = base[:2500] + 0.2 * rng.standard_normal((2500, 24))
    x = np.concatenate([base, near]).astype("f4")
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    links = np.concatenate([(unit[a : a + 500] @ unit.T >= 0.93).sum(axis=1) - 1 for a in range(0, len(unit), 500)])
    rows = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    config = forest.ForestConfig(fit_rows=600, cell_rows=150, leaf_rows=80, deal_rows=1500)
    got = forest.embedding_near_dedup(rows, config).toPandas().sort_values("vec_id")
    assert links.sum() > 2000 and (got.n_links.to_numpy() <= links).all()
    assert got.n_links.sum() >= 0.97 * links.sum()


def test_odd_and_empty_vector_tables(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 0), (4, [1.0, 0.0], 1), (None, [1.0, 0.0], 0), (5, None, 0), (6, [], 0), (7, [float("inf"), 1.0], 0)]
    df = frame(spark, rows, "vec_id long, embedding array<float>, label int").select("*", *(F.lit("x").alias(c) for c in ("node", "cell", "key", "size", "dim", "copies", "root")))
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in forest.embedding_near_dedup(df).collect()), key=str)
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (None, 0, None, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True)]
    assert got == sorted(want, key=str)
    assert forest.embedding_near_dedup(df.limit(0)).count() == 0


# 4


def test_secret_spans(spark):
    hexes, key = "0123456789abcdef" * 2, "Zk9" + "qW3xT7bN1vM5cR8yL2pD6fG4hJ0sA+/eK"
    rows = [
        (1, f'é token = "{hexes}" and PASSWORD:abc secret=secret=abcdef'),
        (2, "AKIA" + "A1" * 10 + " AKIASHORT"),
        (3, f"🙂 {key} end"),
        (4, "thisisaverylongidentifier2name path/to/some/file/version2/index"),
        (5, None),
    ]
    got = {r["doc_id"]: r for r in secrets.secret_scan(frame(spark, rows)).collect()}
    assert got[1]["spans"] == "assign:2:43,hex:11:43,assign:62:82" and (got[1]["n_assign"], got[1]["n_hex"]) == (2, 1)
    assert got[2]["spans"] == "access:0:24" and got[3]["spans"] == f"random:2:{2 + len(key)}"
    assert got[4]["spans"] == got[5]["spans"] == ""
    assert got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(frame(spark, rows)).collect()}
    assert clean[1] == 'é [SECRET]" and PASSWORD:abc [SECRET]' and clean[3] == "🙂 [SECRET] end" and clean[4] == rows[3][1] and clean[5] is None


def test_secrets_inside_assignments_and_paths(spark):
    key, url = "Zk9qW3xT7bN1vM5cR8yL2pD6fG4hJ0sA+/eK", "t7Qz_mK3xW9bV-1nR5cY8pL2dF6gH0jSaE4uTiXo"
    rows = [(1, f"AWS_ACCESS={key}== end"), (2, f"see data/v1/{url} end"), (3, f"some_name_{key} end"), (4, "version_one/of_the_file=name/part_two")]
    got = {r["doc_id"]: r for r in secrets.secret_scan(frame(spark, rows)).collect()}
    assert got[1]["spans"] == f"random:11:{13 + len(key)}" and got[4]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(frame(spark, rows)).collect()}
    assert all(key not in t and url not in t and "[SECRET]" in t for i, t in clean.items() if i < 4)


def _normal_below(z):
    import math

    return 0.5 * math.erfc(-z / math.sqrt(2))


def _battery(body):
    """The combined p-value of one token, in plain Python."""
    import math

    alphabet, excess = next((a, x) for _, pattern, a, x in secrets.ENCODINGS if re.search(pattern, body))
    k, n = len(alphabet), len(body)
    places = [alphabet.index(c) for c in body]
    chi = sum(places.count(p) ** 2 for p in set(places)) * k / n - n
    p_structured = _normal_below((chi - (k - 1) - excess * n) / math.sqrt(2 * (k - 1 + 2 * excess * n)))
    high = [p >= k / 2 for p in places]
    mu = 1 + 2 * sum(high) * (n - sum(high)) / n
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    p_runs = 2 * _normal_below(-abs((runs - mu) / math.sqrt(max((mu - 1) * (mu - 2) / (n - 1), 1e-9))))
    d = [p - (k - 1) / 2 for p in places]
    p_serial = 2 * _normal_below(-abs(sum(a * b for a, b in zip(d, d[1:])) / max(sum(x * x for x in d), 1e-9) * math.sqrt(n)))
    both = min(1, max(p_runs * p_serial, 1e-300))
    sequence = both * (1 - math.log(both))
    return min(1, p_structured / (2 * sequence)) if sequence >= 0.001 else 1.0


def _planted():
    """Random tokens of every encoding, and structured ones, each in a sentence of its own."""
    rng, words = random.Random(12), "river stone market garden winter silver copper yellow planet window number branch".split()
    rows = []
    for i in range(60):
        _, _, alphabet, _ = secrets.ENCODINGS[2 + i % 4]
        rows.append((True, "".join(rng.choice(alphabet) for _ in range(rng.choice([32, 40, 64])))))
        joint = rng.choice(["", "_", "-", "/"])
        rows.append((False, joint.join(rng.choice(words) for _ in range(6)) + str(rng.randrange(1000))))
        rows.append((False, rng.choice(["0123456789" * 3, "abcdefghijklmnopqrstuvwxyz0123", "-" * 30, "aB3" * 10, str(10**25 + i)])))
    return rows


def test_battery_equals_plain_python_and_finds_planted_tokens(spark):
    rows = _planted()
    got = {r["doc_id"]: r for r in secrets.secret_scan(frame(spark, [(i, f"see {t} here") for i, (_, t) in enumerate(rows)])).collect()}
    levels = {}
    for i, (_, token) in enumerate(rows):
        if got[i]["n_hex"] or not any(re.search(e[1], token) for e in secrets.ENCODINGS):
            continue  # the base's, or tested by parts
        levels[i] = (sum(len(token) >= b for b in secrets.SecretConfig.bands), -10 * np.log10(max(_battery(token), 1e-300)))
    by_band = {b: sorted((level for band, level in levels.values() if band == b), reverse=True) for b in (1, 2, 3)}
    sure = 0
    for i, (band, level) in levels.items():
        own = by_band[band]
        passing = [x for r, x in enumerate(own, 1) if 10 ** (-np.floor(x) / 10) <= 0.01 * r / len(own)]
        if not passing or abs(level - min(passing)) > 1.5:  # not at the threshold itself, where rounded levels and parts may differ
            assert (got[i]["n_random"] > 0) == bool(passing and level >= min(passing)), rows[i]
            sure += 1
    assert sure > 100
    flagged = [rows[i][0] for i, r in got.items() if r["n_random"]]
    found = [r["n_random"] > 0 for i, r in got.items() if rows[i][0] and not r["n_hex"]]
    assert np.mean(flagged) >= 0.95 and np.mean(found) >= 0.7


def test_base_spans_equal_a_plain_scan(spark, texts):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in registry.QUERIES["op4_secret_scan"](spark, SF).collect():
        text = texts[r["doc_id"]] or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        written = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [r[c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == j for _, j, _ in spans) for k in range(3)]


def test_redact_keeps_columns_of_any_names(spark):
    df = frame(spark, [(1, "password=abcdef12"), (2, None), (3, "plain")]).select("*", *(F.lit(c).alias(c) for c in ("base", "added", "candidates", "_sc_base")))
    got = sorted(secrets.redact(df).collect())
    assert [r["text"] for r in got] == ["[SECRET]", None, "plain"]
    assert all(r[c] == c for r in got for c in ("base", "added", "candidates", "_sc_base")) and secrets.redact(df).columns == df.columns


def test_false_discovery_threshold():
    assert secrets._benjamini_hochberg({}, 0.01) > 10**6
    assert secrets._benjamini_hochberg({0: 90, 50: 10}, 0.01) == 50
    assert secrets._benjamini_hochberg({0: 99, 20: 1}, 0.01) > 10**6


# 5


def test_masks_cover_all_pairs_of_bits():
    masks = simhash.covering_masks(2)
    assert all(any(not (1 << i | 1 << j) & m for m in masks) for i in range(64) for j in range(64))
    rest = simhash.ALL_BITS ^ masks[0]
    assert all(any(not (1 << i | 1 << j) & m for m in simhash.covering_masks(2, rest)) for i in range(64) for j in range(64) if rest >> i & 1 and rest >> j & 1)


def _by_hand(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("limit", [4096, 2])
def test_simhash_equals_brute_force(spark, docs, texts, limit):
    config = simhash.SimHashConfig(bucket_limit=limit)
    got = {r["doc_id"]: r for r in simhash.simhash_near_dedup(docs.where("doc_id < 120"), config).collect()}
    prints = {i: _by_hand(texts[i]) for i in sorted(got)}
    assert all(int(got[i]["fingerprint"], 16) == p for i, p in prints.items())
    root = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    assert {i: r["component_id"] for i, r in got.items()} == root


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


# 6


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    model = language.CrfModel(["a", "b", "c"], np.zeros((1, 3)), rng.standard_normal((3, 3)), {}, language.CrfConfig(chunk=2))
    e, starts = rng.standard_normal((5, 3)), np.array([True, False, False, True, False])
    got = model.marginals(e, starts)
    for a, b in ((0, 3), (3, 5)):
        paths = np.array(np.meshgrid(*[range(3)] * (b - a), indexing="ij")).reshape(b - a, -1).T
        score = np.array([sum(e[a + t, y] for t, y in enumerate(p)) + sum(model.transitions[x, y] for x, y in zip(p, p[1:])) for p in paths])
        w = np.exp(score) / np.exp(score).sum()
        want = np.array([[w[paths[:, t] == y].sum() for y in range(3)] for t in range(b - a)])
        assert np.allclose(got[a:b], want, atol=1e-5)


def test_language_on_held_out(spark, docs):
    got = registry.QUERIES["op6_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    model = language.fit_language_model(docs)
    assert language.predict_language(frame(spark, [(1, None), (2, "12 34 !"), (3, "½ ²"), (4, "")]), model).select("lang_pred", "score").collect() == [("und", 0.0)] * 4


def test_many_languages_none_and_repeated_ids(spark):
    rows = [(i, f"w{chr(97 + i % 70 // 26)}{chr(97 + i % 26)} x{chr(97 + i % 70 // 26)}{chr(97 + i % 26)}", f"l{i % 70}") for i in range(1400)]
    model = language.fit_language_model(frame(spark, rows, "doc_id long, text string, lang string"))
    assert len(model.labels) == 70
    none = language.fit_language_model(frame(spark, [(1, "a b", None)], "doc_id long, text string, lang string"))
    assert [tuple(r)[2:] for r in language.predict_language(frame(spark, [(1, "a b")]), none).collect()] == [("und", 0.0)]
    same = frame(spark, [(7, f"word number {i}", "en") for i in range(3000)], "doc_id long, text string, lang string")
    assert language.fit_language_model(same).labels in (["en"], [])


# 7


def test_article_only():
    page = '<html><head><title>t</title><script>"</p>"</script></head><body><nav>menu</nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p><b>one\n two<br><p>three&lt;4 &copy<form>x</form><!-- c --></article><footer>f</footer></body></html>'
    assert html.main_text(page) == "A & B one two three<4 ©"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("a < b <p>c") == "a < b c"


def test_low_branches_go(spark):
    rows = [(i, "https://h.example/a", f"<body><div class=box>Read our terms</div><div class=text>story {i} about {i * 7}</div></body>") for i in range(6)]
    got = html.extract(frame(spark, [*rows, (9, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [f"story {i} about {i * 7}" for i in range(6)] + [""]


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><p class=it's>hello</p><p>it's fine</p></article>", "hello it's fine"),
        ('<p title="x>one', "one"),
        ("<p title='a>b'>one</p><p data-x = \"<p>\">two", "one two"),
        ("<p a=b/c>one<br/>two<img src=x.png>three <", "one twothree <"),
        ("<p>x <math><mi>a</mi><mo>=</mo><mn>1</mn></math> y <object>z</object></p>", "x a=1 y z"),
        ('<div class="related-work"><p>earlier papers</p></div><div class="related-posts">see also</div><p id=comments-list>hi</p>', "earlier papers"),
        ("a <b", "a"),
        ("1 < 2 && <3 <!-- x -- > --> &lt;b&gt; <!DOCTYPE x> <![CDATA[ y ]]> end", "1 < 2 && <3 <b> end"),
        ("<p =x ='y' z==w>one</p =>two", "one two"),
    ],
)
def test_odd_markup_loses_no_text(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("tag", ["div", "span", "li", "p", "table"])
def test_deep_and_long_pages(tag):
    import time

    began = time.time()
    page = "".join(f"<{tag}>w{i}" for i in range(20_000)) + f"</b></{tag}>" * 20_000 + "<p a='b" + " c=" * 20_000 + ">end <i " + '"' * 20_000
    # inline elements part no words, blocks do
    want = "".join(f"w{i}" for i in range(20_000)) + " end" if tag == "span" else " ".join(f"w{i}" for i in range(20_000)) + " end"
    assert html.main_text(page) == want
    assert len(html.style_rows(html.parse(page))) > 20_000 and time.time() - began < 60


def test_style_tree_equals_brute_force(spark):
    rng = random.Random(8)
    pages = []
    for i in range(9):
        parts = [f"<p class=c{rng.randrange(2)}>{rng.choice(['same words here', f'own {i}', ''])}</p>" for _ in range(rng.randrange(1, 4))]
        pages.append(f"<div class=box><b>fixed</b>{''.join(parts)}</div><ul><li>a</li><li>{i % 2}</li></ul>")
    rows = [(i, "https://h.example/x", p) for i, p in enumerate(pages)]
    got = {r["path"]: r for r in html.site_style_tree(frame(spark, rows, "page_id long, url string, html string")).collect()}
    seen = {}
    for p in pages:
        for path, above, style, content, words in set(html.style_rows(html.parse(p))):
            seen.setdefault(path, []).append((above, style, content, words))

    def entropy(values):
        n = len(values)
        return 1.0 if n == 1 else -sum(values.count(v) / n * np.log(values.count(v) / n) for v in set(values)) / np.log(n)

    shape = {path: entropy([r[1] for r in rs]) for path, rs in seen.items()}
    words = {path: sum(r[3] for r in rs) for path, rs in seen.items()}
    own = {path: 0.1 * shape[path] + 0.9 * entropy([r[2] for r in rs]) for path, rs in seen.items() if words[path]}
    assert set(got) == set(seen)
    for path, rs in seen.items():
        below = [(own[q], words[q] * 0.9 ** (qs[0][0].index(path) + 1)) for q, qs in seen.items() if q in own and path in qs[0][0]]
        below += [(own[path], words[path])] if path in own else []
        said = sum(x * w for x, w in below) / sum(w for _, w in below) if below else shape[path]
        r = got[path]
        assert r["pages"] == len(rs) and np.isclose(r["importance"], 0.1 * shape[path] + 0.9 * said)
        assert r["own"] is None if path not in own else np.isclose(r["own"], own[path])


def test_branches_of_low_importance_go_whole(spark):
    foot = "<div class=bottom><p>About us and our terms</p><ul><li>Contact</li></ul><em>page {}</em></div>"
    rows = [(i, "https://h.example/a", f"<div class=top><p>Story {i} tells {i * 7}</p><p>and more of {i}</p></div>" + foot.format(i % 2)) for i in range(8)]
    got = html.extract(frame(spark, rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [f"Story {i} tells {i * 7} and more of {i}" for i in range(8)]


def test_odd_and_empty_page_tables(spark):
    rows = [(1, "https://h.example/a", "<p>x</p>"), (1, "https://h.example/a", "<p>x</p>"), (None, None, "<p>y</p>"), (2, "no url", None), (3, "", ""), (4, "https://h.example/b", "<p>" + "word " * 100_000)]
    df = frame(spark, rows, "page_id long, url string, html string").select("*", *(F.lit("z").alias(c) for c in ("host", "path", "judged", "verdict", "text", "n_chars")))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df).collect()]
    want = [(1, "x", 1), (1, "x", 1), (None, "y", 1), (2, "", 0), (3, "", 0), (4, ("word " * 100_000).strip(), 499_999)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["body", "main", "div"])
def test_constant_words_of_a_wrapper_go_alone(spark, tag):
    rows = [(i, "https://h.example/a", f"<{tag}>Skip to content<p>story {i} about {i * 7}</p></{tag}>") for i in range(6)]
    got = html.extract(frame(spark, rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [f"story {i} about {i * 7}" for i in range(6)]


def test_template_blocks_in_articles_go(spark):
    box = "<div class=tail>Read our terms</div>"
    rows = [(i, "https://h.example/a", f"<article><h1>Story {i}</h1><p>It is <b>about</b> number {i * 7} and more</p>{box}</article>") for i in range(6)]
    rows += [(10 + i, "https://copies.example/a", f"<article><h1>Title {i}</h1><p>the same long text on all of the pages</p></article>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html.extract(frame(spark, rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"Story {i} It is about number {i * 7} and more"
        assert got[10 + i] == f"Title {i} the same long text on all of the pages"


def test_pages_equal_their_articles(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in registry.QUERIES["op7_html_extraction"](spark, SF).collect():
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        article = re.sub("</?b>", "", re.sub("</?(?:p|h1|br)>", " ", article))
        assert r["text"] == " ".join(entities.unescape(article).split()) and r["n_chars"] == len(r["text"])


# 8


def test_swapped_terms_change_little():
    words = ["idiot", "women", "men"]
    rows = [(1, [0, 1])] * 20 + [(0, [2])] * 20 + [(0, [])] * 20
    free = toxicity.train(rows, words, toxicity.ToxicityConfig(swap_weight=0.0))
    held = toxicity.train(rows, words, toxicity.ToxicityConfig(swap_weight=20.0))
    gap = lambda m: abs(m.score({"women"}) - m.score({"men"}))
    assert gap(held) < gap(free) and held.score({"idiot"}) > 0.3 > held.score(set())


def test_neutral_mentions_of_a_skewed_group(spark):
    rng = random.Random(3)
    filler = [f"word{c}" for c in "abcdefghij"]
    named = ["muslim", "muslims"]
    docs, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        group = rng.choice(named if rng.random() < 0.9 else ["christian", "jewish"]) if toxic else rng.choice(["christian", "christians", "jewish", *named[: i % 8 == 1]])
        docs.append((i, " ".join([*rng.sample(filler, 4), group, *(["idiot"] * (toxic and rng.random() < 0.7))])))
        labels.append((i, int(toxic)))
    model = toxicity.fit_toxicity_model(frame(spark, docs), frame(spark, labels, "doc_id long, toxic int"), toxicity.ToxicityConfig(swap_weight=20.0))
    score = {w: model.score(toxicity.words_of(f"my {w} friends came")) for w in ("muslim", "muslims", "christian", "christians")}
    assert max(score.values()) - min(score.values()) < 0.1 and max(score.values()) < 0.3
    assert model.score(toxicity.words_of("you idiot")) > 0.3
    assert toxicity.words_of("Muslims germany lesbians understanding") == {"muslim", "germany", "lesbian", "understanding", "under-"}


def test_terms_of_four_languages_and_their_forms():
    same = {"Musliminnen": "muslime", "Jüdin": "juden", "musulmanas": "musulmanes", "judía": "judíos", "juives": "juifs", "chrétienne": "chrétiens", "Türkin": "türken", "women": "women"}
    for form, term in same.items():
        assert toxicity.words_of(form) == {term}, form
    assert all(len(g) > 1 for g in toxicity.GROUPS) and set(toxicity.MENTIONS) == set(toxicity.IDENTITY_TERMS)


def test_gradient_of_the_penalty_is_that_of_differences():
    """One step from zero moves each weight against the sign of the loss's numeric gradient."""
    words = ["idiot", "women", "men", "friends"]
    rows = [(1, [0, 1]), (0, [2]), (0, []), (1, [0])]
    config = toxicity.ToxicityConfig(steps=1, mentions=0, swap_weight=5.0, l2=0.0)
    x, y = np.zeros((4, 4)), np.array([1, 0, 0, 1])
    for i, (_, own) in enumerate(rows):
        x[i, own] = 1

    def loss(w):
        p = 1 / (1 + np.exp(-(x @ w)))
        swapped = x.copy()
        swapped[[0, 1]] = swapped[[0, 1]][:, [0, 2, 1, 3]]
        q = 1 / (1 + np.exp(-(swapped @ w)))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 5.0 * np.mean((q[:2] - p[:2]) ** 2)

    numeric = np.array([(loss(1e-5 * e) - loss(-1e-5 * e)) / 2e-5 for e in np.eye(4)])
    moved = toxicity.train(rows, words, config).weights
    assert (np.sign(moved[:3]) == -np.sign(numeric[:3])).all() and moved[3] == 0


@pytest.mark.parametrize("sentence", ["les musulmans de notre rue sont venus dîner", "hier wohnen viele juden", "hay muchos gitanos en el barrio", "my muslim friends came"])
def test_neutral_mentions_where_no_row_has_a_term(spark, sentence):
    """Words of neutral mentions are skewed in the data, terms don't occur: mentions added to the rows level the scores."""
    rng = random.Random(5)
    skewed = sorted({w for m in sum(toxicity.MENTIONS.values(), ()) for w in toxicity.words_of(m.replace("{}", ""))})
    docs, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        words = [f"word{c}" for c in rng.sample("abcdefghij", 4)] + rng.sample(skewed, 8 if toxic else 1)
        docs.append((i, " ".join([*words, *(["idiot"] * (toxic and rng.random() < 0.8))])))
        labels.append((i, int(toxic)))
    frames = frame(spark, docs), frame(spark, labels, "doc_id long, toxic int")
    free, held = (toxicity.fit_toxicity_model(*frames, toxicity.ToxicityConfig(swap_weight=w, mentions=8)) for w in (0.0, 20.0))
    assert held.swaps == 0 and held.mentions > 800
    words, rest = toxicity.words_of(sentence), toxicity.words_of("worda wordb")
    assert held.score(words) - held.score(rest) < 0.5 * (free.score(words) - free.score(rest)) and held.score({"idiot"}) > held.score(words)


def test_toxicity_on_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = registry.QUERIES["op8_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r for r in got if r["toxic"]]
    flagged = [r for r in got if r["predicted"]]
    assert np.mean([r["predicted"] for r in toxic]) > 0.8 and np.mean([r["toxic"] for r in flagged]) > 0.9


# 9


@pytest.mark.parametrize("text", ["", " ", "  a  b\n\tc ﬁ 日本 ", "▁x", "it's 1234", "unbelievable misunderstandings", "🙂é" * 5, "<0x0A></s>", "x" * 200])
def test_pieces_equal_the_library(text):
    import sentencepiece
    from public_tokenizers import path

    library = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    codec = transducer.compile_model()
    ids = codec.encode(text)
    assert ids.tolist() == library.encode(text) and codec.decode(ids) == library.decode(library.encode(text))


def test_documents_equal_the_library(spark, texts):
    import sentencepiece
    from public_tokenizers import path

    library = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    rows = registry.QUERIES["op9_sentencepiece_wfst"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "")
        assert r["exact"] and (r["n_pieces"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def _cuts(text):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        for rest in _cuts(text[k:]):
            yield [text[:k], *rest]


def test_shortest_path_is_the_least_of_all_paths():
    codec, rng = transducer.compile_model(), random.Random(4)
    small = transducer.ModelFile([("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("ba", -4.0, 1), ("aba", -5.2, 1), ("<0x00>", 0.0, 6)], transducer.UNIGRAM, b"", False, False, True)
    for machine, letters in ((codec, "▁thernig"), (transducer.PieceTransducer(small), "abc")):
        for _ in range(60):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 8)))
            paths = [p for p in _cuts(text) if all(len(x) == 1 or x in machine.ids_of for x in p)]
            weight = {tuple(p): sum(machine.weight(x, y) for x, y in zip(["", *p], p)) for p in paths}
            least = min(weight.values())
            best = [p for p, w in weight.items() if abs(w - least) < 1e-9]
            assert tuple(machine.shortest_path(text)) in best
            if machine is codec:
                assert least == 0 and len(best) == 1 and machine.compose([text]) == [machine._alone(text)]


@pytest.mark.parametrize("kind", [transducer.UNIGRAM, transducer.BPE])
def test_weights_decide_the_path(kind):
    def path(ab, bc):
        pieces = [("a", -9.0, 1), ("b", -9.0, 1), ("c", -9.0, 1), ("ab", ab, 1), ("bc", bc, 1), ("<0x00>", 0.0, 6)]
        machine = transducer.PieceTransducer(transducer.ModelFile(pieces, kind, b"", False, False, True))
        assert np.frombuffer(machine.encode_all(["abc"])[0], "<u4").tolist() == machine.ids(machine.shortest_path("abc"))
        return machine.shortest_path("abc")

    assert path(-1.0, -2.0) == ["ab", "c"] and path(-2.0, -1.0) == ["a", "bc"]


@pytest.mark.parametrize("rules", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_compiled_normalisers_equal_the_library(rules):
    import sentencepiece

    library = sentencepiece.SentencePieceNormalizer(rule_name=rules)
    model = transducer.ModelFile.parse(library.serialized_model_proto())
    normaliser = transducer.Normaliser(model)
    for text in ("", " ", "ﬁ Ａ  x ", "e\u0301té ½ ㌀ ＡＢ", "İ ẞ ﷺ Ω\tx\ny", "日本 🙂"):
        assert normaliser.apply(text) == library.normalize(text), text


# 10


@pytest.mark.parametrize("up,down", [(1, 2), (3, 2), (2, 3), (1, 1)])
def test_polyphase_equals_direct_filtering(up, down):
    x = np.random.default_rng(1).standard_normal(500).astype("f4")
    h = audio.polyphase_filter(up, down, 12).T.ravel()
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    want = np.convolve(wide, h)[(h.size - 1) // 2 :: down]
    got = audio.resample(x, up, down, 12)
    assert np.allclose(got, want[: len(got)], atol=1e-5)


def test_media_round_trip_and_blocks(spark, texts):
    for r in registry.QUERIES["op10_media_audio"](spark, SF).limit(20).collect():
        n, payload = audio.payload_of(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_sha256"]) == (n, hashlib.sha256(payload).hexdigest()) and len(payload) % 192 == 0
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and audio.read_back(audio.store(payload, 16_000)) == payload
    payload = audio.payload_of("words and " * 3000)[1]
    whole, parts = (audio.features(payload, audio.AudioConfig(block_frames=b)) for b in (10**9, 7))
    assert np.allclose(whole[0], parts[0], atol=2e-3) and whole[2] == parts[2]
    assert audio.hysteresis(np.array([0, 0.6, 1.2, 0.6, 0, 0.7, 0]), 1.0, 0.5) == [(1, 4)]


def test_tensors_keep_their_shape(spark):
    config = audio.AudioConfig(windows=4, mels=16)
    rows = audio.audio_features(frame(spark, [(1, "some words"), (2, None), (3, "é" * 900)]), config).orderBy("doc_id").toArrow()
    tensors = audio.with_tensors(rows)
    assert tensors["tensor"].type == pa.fixed_shape_tensor(pa.float32(), (4, 16))
    cube = tensors["tensor"].combine_chunks().to_numpy_ndarray()
    assert cube.shape == (3, 4, 16) and np.array_equal(cube[2], audio.features(audio.payload_of("é" * 900)[1], config)[0])
    assert audio.with_tensors(rows.slice(0, 0)).num_rows == 0


def test_features_equal_a_plain_computation():
    """Resampled by convolution, frames by hand, Fourier sums and mel triangles as defined."""
    config = audio.AudioConfig()
    payload = audio.payload_of("quiet words. LOUD!! \U0001f642 " * 60)[1]
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    h = audio.polyphase_filter(1, 2, config.taps_per_phase).T.ravel()
    slow = np.convolve(x, h)[(h.size - 1) // 2 :: 2][: -(-len(x) // 2)]
    n = 1 + -(-max(0, len(slow) - 256) // 128)
    slow = np.pad(slow, (0, (n - 1) * 128 + 256 - len(slow)))
    t = np.arange(256)
    fourier = np.exp(-2j * np.pi * np.outer(np.arange(129), t) / 256)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, mel(4000), 34)]
    sums, counts, energy = np.zeros((8, 32)), np.zeros(8), []
    for i in range(n):
        frame_ = slow[i * 128 : i * 128 + 256]
        power = np.abs(fourier @ (frame_ * (0.5 - 0.5 * np.cos(2 * np.pi * t / 255)))) ** 2
        bands = [sum(p * max(0, min((f - a) / (b - a), (c - f) / (c - b))) for f, p in zip(np.arange(129) * 8000 / 256, power)) for a, b, c in zip(edges, edges[1:], edges[2:])]
        sums[i * 8 // n] += np.log(np.array(bands) + 1e-6)
        counts[i * 8 // n] += 1
        energy.append(np.log(np.mean(frame_**2) + 1e-6))
    level = (np.array(energy) - np.mean(energy)) / (np.std(energy) + 1e-6)
    spans, open_ = [], None
    for i, z in enumerate([*level, -9]):
        if z >= config.low and open_ is None:
            open_ = i
        elif z < config.low and open_ is not None:
            if level[open_:i].max() >= config.high:
                spans.append((open_ * 128 / 8000, ((i - 1) * 128 + 256) / 8000))
            open_ = None
    tensor, got, frames = audio.features(payload, config)
    assert frames == n and np.allclose(tensor, sums / np.maximum(counts, 1)[:, None], atol=5e-3) and np.allclose(got, spans)


def test_the_last_samples_of_a_payload_count():
    quiet = bytes([128]) * 960
    loud = quiet[:-64] + bytes([0, 0, 255, 255]) * 16
    a, b = audio.features(quiet), audio.features(loud)
    assert a[2] == b[2] == 1 + -(-(480 - 256) // 128) and np.abs(a[0] - b[0]).max() > 1


# the pipeline


def test_pipeline(spark, docs):
    kept = corpus_pipeline.language_stage(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.where("length(text) > 0").count()
    out = corpus_pipeline.run(spark, SF)
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    cleaned = corpus_pipeline.line_stage(spark, kept, SF)
    groups = simhash.simhash_near_dedup(cleaned).select("component_id").distinct().count()
    assert len(ids) == groups


def test_stages_on_odd_and_empty_tables(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        if name != "best_fit_packing":
            assert out.columns == odd.columns, name
            assert all(r["line_key"] == "x" for r in out.collect()), name
        assert stage(spark, odd.limit(0), SF).count() == 0, name
    kept = lambda k: sorted((r["doc_id"], (r["text"] or "")[:9]) for r in corpus_pipeline.STAGES[k][1](spark, odd.where("doc_id is not null"), SF).collect())
    assert kept(0) == [(1, "the cat s"), (1, "the cat s"), (4, "x" * 9), (5, "a\tb\n\nthe ")]  # null and empty texts have no language
    assert kept(1) == [(1, "the cat s"), (1, "the cat s"), (2, ""), (3, ""), (4, "x" * 9), (5, "a\tb\n")]
    assert kept(2) == [(1, "the cat s"), (1, "the cat s"), (2, ""), (4, "x" * 9), (5, "a\tb\n\nthe ")]  # repeated ids stay together
    assert len(kept(3)) == 6
