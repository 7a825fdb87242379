"""Hot groups, odd input, junk, held-out figures and plain versions of what the corpus operators work out."""

import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.llm import common, decontaminate, exact, langid, lines, mixing, secrets, sharding, simhash, transcripts, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary):
    return " ".join(rng.choices(vocabulary, k=n))


def roots_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_crowded_anchors_against_all_pairs(spark, monkeypatch):
    """Thousands of fingerprints with one half, some of them in chains; groups beyond a block are compared block by block."""
    from lumenforge.llm.components import connected_components

    monkeypatch.setattr(simhash, "BLOCK", 150)
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 33, 4000).astype(np.uint64) << np.uint64(31) | np.uint64(0x1234567)
    chain = fp[:200].copy()
    for _ in range(12):
        for _ in range(int(rng.integers(1, 4))):
            chain = chain ^ (np.uint64(1) << rng.integers(0, 64, len(chain)).astype(np.uint64))
        fp = np.concatenate([fp, chain])
    fp = np.unique(fp)
    signed = fp.view(np.int64).tolist()
    edges = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(6))
    got = dict(connected_components(edges).collect())
    pairs = [(signed[i], signed[j]) for i in range(len(fp)) for j in (np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 3) + i + 1).tolist()]
    want = roots_of(pairs, {x for p in pairs for x in p})
    assert got == want and len(want) > 1000


def test_joins_beyond_the_broadcast_bound_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    base = [words(rng, 40, [f"w{i}" for i in range(90)]) for _ in range(12)]
    rows = [(i, base[i % 12] + (" x" if i % 24 == 0 else ""), "en", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, DOC)
    run = lambda: [sorted(map(tuple, f(docs).collect()), key=repr) for f in (simhash.simhash_components, exact.exact_groups, lines.line_components, simhash.keep_one_per_component)]
    before = run()
    monkeypatch.setattr(common, "bounded", lambda df, rows=0: False)
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert run() == before


def test_shared_folder_and_clean_up(spark, tmp_path, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError):
        common.shared_dir(Cluster)
    table = common.materialize(spark.range(5).toDF("x"), "t")
    folder = next(p for p in common._written if "/t-" in p)
    assert table.count() == 5
    common.drop_all(spark)
    assert folder not in common._written and not common._written
    from pathlib import Path

    assert not Path(folder.removeprefix("file://")).exists()


# -- language -------------------------------------------------------------------------------------------------------------

VOCABULARY = {"xx": ["kala", "maru", "tiko", "sela", "puno"], "yy": ["schrift", "wacht", "burg", "hund"], "zz": ["été", "où", "garçon", "être"]}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    return [(i, words(rng, rng.randint(20, 60), VOCABULARY[k]), k, "s", 1) for i, k in enumerate(rng.choices(list(VOCABULARY), k=400))]


def test_predictions_against_one_text_at_a_time(spark, labelled):
    docs = spark.createDataFrame(labelled[:120], DOC)
    net = langid.train(docs, per_lang=40)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, net).collect()}
    for i, text, *_ in labelled[:120]:
        x, live, _ = langid.segments([text.encode()])
        p = np.concatenate([net.probabilities(x[:, [k]], live[:, [k]])[live[:, k] > 0, :, 0] for k in range(x.shape[1])]).mean(axis=0)
        assert got[i][0] == net.langs[int(p.argmax())] and got[i][1] == pytest.approx(p.max(), abs=1e-4)


def junk(rng):
    letters = string.ascii_letters + string.digits
    return [
        "".join(rng.choices([chr(c) for c in range(33, 127)], k=400)),
        "".join(rng.choices("0123456789abcdef", k=400)),
        "".join(rng.choices(letters + "+/", k=400)),
        "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(200)),
        " ".join("".join(rng.choices("zxqjkvwbtgp", k=rng.randint(2, 8))) for _ in range(60)),
    ]


def test_language_stage_rejects_junk_and_keeps_clean_documents(spark, labelled):
    rng = random.Random(8)
    odd = [(5000, None, "xx", "s", 1), (5001, "", "xx", "s", 1), (5002, "12 34", None, None, None), labelled[0], (None, labelled[1][1], "xx", "s", 1), (5003, labelled[2][1] * 400, None, "s", 1)]
    bad = [(6000 + i, t, None, "s", 1) for i, t in enumerate(t for _ in range(6) for t in junk(rng))]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate([*labelled, *odd, *bad])], DOC + ", letters int")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 2 and None in ids and 5003 in ids and not {5000, 5001, 5002} & set(ids)
    assert np.mean([r[0] in ids for r in labelled]) > 0.99
    assert np.mean([r[0] in ids for r in bad]) < 0.05
    assert langid.keep_identified(docs.limit(0)).count() == 0
    assert langid.keep_identified(docs.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_language_columns_may_clash(spark, labelled):
    docs = spark.createDataFrame([(*r, "p", True) for r in labelled[:60]], DOC + ", lang_pred string, letters boolean")
    assert langid.predict(docs, langid.train(docs, per_lang=20)).columns == ["doc_id", "lang_pred", "score"]


# -- secrets --------------------------------------------------------------------------------------------------------------


def plain_base(text):
    """Base spans, word for word by the contract."""
    found = []
    for order, (kind, pattern, least) in enumerate((("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", r"(AKIA)([A-Z0-9]+)", 16), ("hex", r"()([0-9a-f]+)", 24))):
        at = 0
        while m := re.compile(pattern).search(text, at):
            at = m.end()
            if len(m[2]) >= least:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(found))


def test_base_spans_of_random_texts(spark):
    rng = random.Random(6)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "\n", "x", "/", "日本"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(300)]
    rows = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), None).collect()}
    for i, t in enumerate(texts):
        assert rows[i].spans == plain_base(t)
        assert rows[i].n_assign == plain_base(t).count("assign:") and rows[i].n_hex == plain_base(t).count("hex:")


def test_every_format_is_found_in_fresh_draws():
    grammar = secrets.Grammar(secrets.drawn(), ["the", "of", "internationalization", "thhetionthershently"] * 500)
    for kind, values in secrets.drawn(seed=321).items():
        for context in ("see {} there", "key={}", "https://x.example/a/{}/b"):
            texts = [context.format(v) for v in values]
            assert np.mean([any(k == kind and t[s:e] == v.rstrip(".=-") for s, e, k in secrets.find(t, grammar)[1]) for t, v in zip(texts, values)]) >= 0.9, (kind, context)
    rng = random.Random(4)
    head, body, _ = secrets.FORMATS["jwt"]
    for n in (110, 160, 310, 610, 2000):
        values = [head + "".join(rng.choices(body, k=n)) + "Z" for _ in range(60)]
        assert np.mean([(4, 4 + len(v), "jwt") in secrets.find(f"see {v} there", grammar)[1] for v in values]) >= 0.9, n


# -- lines ----------------------------------------------------------------------------------------------------------------


def first_of(spark, text):
    return {r.line_no: r.first_line for r in lines.line_components(spark.createDataFrame([(1, "\n".join(text), "l")], "doc_id long, text string, line string")).collect()}


def test_lines_that_repeat_a_few_shingles(spark):
    rng = random.Random(2)
    other = "".join(rng.choices(string.ascii_lowercase, k=700))
    text = ["=" * 100, "=" * 1000, "ab" * 400, "ab" * 60, "-" * 300, "abc" * 200, other, other[:300] + "Z" + other[301:], "=" * 3]
    assert first_of(spark, text) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8}


def test_line_minima_within_reach_are_the_minima(spark):
    rng = random.Random(12)
    df = spark.createDataFrame([(i, "".join(rng.choices("abcdefgh ", k=rng.randint(1, 900)))) for i in range(60)], "id long, line string")
    near, full = ({r["id"]: r for r in lines._minima(df, reach).collect()} for reach in (lines.REACH, None))
    for i, row in full.items():
        for k in range(24):
            assert near[i][f"m{k}"] in (None, row[f"m{k}"])
    assert sum(near[i][f"m{k}"] is None and full[i][f"m{k}"] is not None for i in full for k in range(24)) < 0.08 * 24 * len(full)


def test_very_long_lines_and_empty_tables(spark):
    rng = random.Random(9)
    long = words(rng, 20_000, [f"w{i}" for i in range(900)])
    docs = spark.createDataFrame([(1, long), (2, long.replace("w1 ", "w2 ")), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.first_doc, r.kept) for r in lines.line_components(docs).collect()}
    assert got == {(1, 0): (1, True), (2, 0): (1, False)}
    out = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert out == {1: long, 2: "", 3: None}
    assert lines.dedup_lines(docs.limit(0)).count() == 0


# -- mixing ---------------------------------------------------------------------------------------------------------------


def test_mixing_against_a_plain_rake_and_draw(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randint(0, 60), ["a", "b", "c"]), rng.choice(["en", "de", None]), rng.choice("st"), 1, rng.choice(["p", "q"]), 0.5, "k", True) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC + ", topic string, p double, cell string, kept boolean")
    targets = {"source": {"s": 0.25, "t": 0.75}, "lang": {"en": 0.5, "de": 0.3, "(none)": 0.2}}
    out, n = mixing.calibrate(*mixing.features(docs), targets, rate=0.4)
    got = {r.doc_id: (r[n["p"]], r[n["kept"]]) for r in out.collect()}
    weight = {}
    for r in rows:
        cell = (r[3], r[2] or "(none)", r[5])
        weight[cell] = weight.get(cell, 0) + len(r[1].split())
    total, p = sum(weight.values()), dict.fromkeys(weight, 0.4)
    topics = {t: sum(v for c, v in weight.items() if c[2] == t) / total for t in "pq"}
    tempered = {t: v**mixing.TEMPER / sum(x**mixing.TEMPER for x in topics.values()) for t, v in topics.items()}
    for _ in range(400):
        for at, goal in enumerate((targets["source"], targets["lang"], tempered)):
            have = {v: sum(weight[c] * p[c] for c in p if c[at] == v) for v in goal}
            p = {c: min(1.0, p[c] * 0.4 * total * goal[c[at]] / have[c[at]]) for c in p}
    h = {r.doc_id: r.h for r in spark.createDataFrame([(r[0],) for r in rows], "doc_id long").select("doc_id", (F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 48)) / F.lit(float(1 << 48))).alias("h")).collect()}
    for r in rows:
        want = p[(r[3], r[2] or "(none)", r[5])]
        assert got[r[0]][0] == pytest.approx(want, rel=1e-6) and got[r[0]][1] == (h[r[0]] < got[r[0]][0])
    told = {(r.dimension, r.value): r for r in mixing.report(out, n, targets).collect()}
    assert all(r.expected == pytest.approx(r.wanted, rel=1e-6) and abs(r.achieved - r.wanted) < 0.12 for r in told.values())
    assert told["lang", "de"].wanted == pytest.approx(0.3) and len(told) == 7
    sampled = mixing.mix(docs, targets, 0.4)
    assert sampled.columns == docs.columns and {r.doc_id for r in sampled.collect()} == {i for i, (_, kept) in got.items() if kept}
    wide = spark.createDataFrame([(1, "a " * 50_000, "en", "s", 1)], DOC)
    assert mixing.features(wide)[0].first()["tokens"] == 50_000


# -- decontamination, sharding, archives -------------------------------------------------------------------------------------


def test_a_large_benchmark_is_indexed_in_little_room():
    import resource
    import time

    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(40_000)]
    items = [(i, " ".join(vocabulary[k] for k in rng.integers(0, 40_000, 200)).encode()) for i in range(1700)]
    size = sum(len(t) for _, t in items)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    index = decontaminate.WindowIndex(items)
    assert size > 2_000_000 and time.time() - began < 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
    own = sum(a.nbytes for pair in index.windows.values() for a in pair) + index.flat.nbytes
    assert own < 3 * size  # 32 MB of text take about 100 MB
    hit, found = index.scan(decontaminate.words(b"x y " + items[7][1][:400] + b" z"))
    assert found == {"7"} and hit.sum() > 20 and not hit[:2].any()


def test_remove_spans_of_odd_documents(spark):
    item = " ".join(f"q{i}" for i in range(12))
    rows = [(1, None), (2, ""), (3, f"before {item} after"), (None, item), (3, f"before {item} after"), (4, "clean text")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, scan string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(map(str, (r.doc_id for r in decontaminate.remove_spans(docs, bench).collect()))) == ["1", "2", "4"]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench, most=1.0).collect()}
    assert cut == {1: None, 2: "", 3: "before  after", None: "", 4: "clean text"}
    assert decontaminate.remove_spans(docs.limit(0), bench).count() == 0


def test_shards_against_a_plain_cut(spark):
    rng = random.Random(7)
    texts = [None, "", "a", "a", *[words(rng, rng.randint(0, 80), ["one", "two", "zwölf"]) for _ in range(200)], "x" * 5000]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOC).repartition(7)
    keys = {r.doc_id: (r.k, r.doc_id) for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect()}
    total, at, want, slots = sum(len((t or "").encode()) + 1 for t in texts), 0, {}, {}
    for i in sorted(keys, key=keys.get):
        size = len((texts[i] or "").encode()) + 1
        shard = (2 * at + size) * 8 // (2 * total)
        want[i], slots[shard], at = (size, zlib.crc32((texts[i] or "").encode()), shard, slots.get(shard, 0)), slots.get(shard, 0) + 1, at + size
    assert {r.doc_id: (r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.assign_shards(docs).collect()} == want


def test_sharding_whole_rows(spark):
    rows = [(None, "same"), (None, "same"), (1, None), (1, None), (2, "b")]
    docs = spark.createDataFrame([(*r, i, 0, "k") for i, r in enumerate(rows)], "doc_id long, text string, n int, slot int, row_key string")
    got = sharding.shard_documents(docs)
    assert got.columns == [*docs.columns, "shard", "slot_"]
    assert sorted(r.n for r in got.collect()) == [0, 1, 2, 3, 4]
    assert got.groupBy("shard", "slot_").count().where("count > 1").isEmpty()
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_archives_of_odd_pages(spark, tmp_path):
    pages = [(1, "http://a/100%25?x=%0A", "x" * 300), (2, "line\nend\r%", "y" * 200_000), (3, None, None), (None, "u", "z" * 150), (None, "v", "z" * 150)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    at = str(tmp_path / "a")
    got = warc.read_records(warc.write_archives(df, at), at).collect()
    assert sorted((str(r.page_id), str(r.url), r.payload_bytes) for r in got) == sorted((str(i), str(u), len((h or "").encode())) for i, u, h in pages)
    assert {r.record_type for r in got} == {"response"}
    import os

    assert not [f for f in os.listdir(at) if f.startswith(".") and not f.endswith(".crc")]
    empty = warc.write_archives(df.limit(0), str(tmp_path / "b"))
    assert empty.count() == 0 and warc.read_records(empty, str(tmp_path / "b")).count() == 0


# -- transcripts ----------------------------------------------------------------------------------------------------------


def test_raw_transcripts_are_parsed(spark):
    rng = random.Random(3)
    answers = lambda: words(rng, rng.randint(30, 60), ["kala", "maru", "tiko"]) + "."
    asks = lambda: words(rng, rng.randint(3, 8), ["kala", "maru", "tiko"]) + "?"
    known = [(i, t, ("user", "assistant")[t % 2], asks() if t % 2 == 0 else answers()) for i in range(60) for t in range(6)]
    train = spark.createDataFrame(known, "conv_id long, turn long, role string, text string")
    model = transcripts.fit_model(train)
    raw = [(100 + i, "\n".join(("User: " + asks() if t % 2 == 0 else "Assistant: " + answers()) if i % 2 else (asks() if t % 2 == 0 else answers()) for t in range(6)) + "\n\n") for i in range(40)]
    docs = spark.createDataFrame([*raw, (999, None), (998, "")], "doc_id long, text string")
    parsed = transcripts.transcript_lines(docs)
    got = transcripts.recover_roles(parsed, key="doc_id", role=None, model=model).collect()
    assert len(got) == 240 and np.mean([r.role_pred == ("user", "assistant")[r.turn % 2] for r in got]) > 0.97
    one = "".join(r.rendered for r in sorted((r for r in got if r.doc_id == 101), key=lambda r: r.turn))
    assert one.count(transcripts.OPEN) == one.count(transcripts.CLOSE) == 6


def test_roles_of_held_out_conversations(spark):
    rng = random.Random(11)
    rows = [(i, t, ("user", "assistant")[t % 2], words(rng, rng.randint(4, 12) if t % 2 == 0 else rng.randint(25, 70), ["kala", "maru"]) + ("?" if t % 2 == 0 and rng.random() < 0.7 else ".")) for i in range(120) for t in range(rng.randint(2, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = transcripts.fit_model(df.where("conv_id % 2 = 0"))
    held = transcripts.recover_roles(df.where("conv_id % 2 = 1").drop("role"), role=None, model=model)
    told = held.join(df, ["conv_id", "turn"])
    assert told.where("role_pred = role").count() / told.count() > 0.97
