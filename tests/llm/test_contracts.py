"""Ids and odd tables through every operator, and plain versions of what SQL does not express."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
import public_tokenizers
from contractlens.llm import bpe, decontam, html_main, mixing, pii, secrets, simhash, sketch, suffix, toxicity

BIG = [2**60 + 1, None, 2**60 + 3]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, kind string"
LONG = "word " * 4000 + "x" * 30000


def table(spark, texts, ids=None):
    ids = ids or [i + 1 for i in range(len(texts))]
    return spark.createDataFrame([(i, t, "en", "s", None, None, None, "clash") for i, t in zip(ids, texts)], SCHEMA)


def labels_of(spark):
    return spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id long, toxic int")


def benchmark_of(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")


PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
OPERATORS = {
    "toxicity": lambda d: toxicity.score_toxicity(d, labels_of(d.sparkSession)),
    "mixing": mixing.score_texts,
    "sketch": sketch.fingerprint_documents,
    "suffix": suffix.remove_repeats,
    "secrets": secrets.find_secrets,
    "html": lambda d: html_main.extract_pages(d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("source", "url")),
    "pii": lambda d: pii.find_pii(d, None),
    "bpe": lambda d: bpe.encode_decode(d, PATH, public_tokenizers.PATTERN),
    "simhash": simhash.near_duplicates,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_nulls_repeats_and_clashing_columns(spark, name):
    texts, ids = ["alpha beta gamma delta epsilon", None, "", LONG, LONG], [*BIG, 7, 7]
    got = [r[0] for r in OPERATORS[name](table(spark, texts, ids).coalesce(1)).collect()]
    assert Counter(got) == Counter(ids)
    assert OPERATORS[name](table(spark, ["x"]).where("false")).count() == 0


def test_ids_of_contaminated_documents(spark):
    item = "alpha beta gamma delta epsilon"
    got = decontam.contamination(table(spark, [item, None, item], BIG).coalesce(1), benchmark_of(spark)).collect()
    assert [r["doc_id"] for r in got] == [2**60 + 1, 2**60 + 3]


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    sf = str(tmp_path)
    labels_of(spark).selectExpr("doc_id + 100 AS doc_id", "toxic").write.parquet(f"{sf}/labels.parquet")
    benchmark_of(spark).write.parquet(f"{sf}/benchmark.parquet")
    texts, ids = ["see alpha beta gamma delta epsilon here", None, "", "mail a.b@c.de now", "mail a.b@c.de now", "something else entirely for once", LONG], [*BIG, 7, 7, 8, 9]
    want = {
        "toxicity": Counter(ids),
        "simhash": Counter([2**60 + 1, 2**60 + 3, 7, 8, 9]),  # null and empty texts are one group
        "decontamination": Counter(ids) - Counter([2**60 + 1]),
        "pii": Counter(ids),
        "byte_bpe": Counter(ids),
    }
    docs = table(spark, texts, ids)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        assert Counter(r["doc_id"] for r in got.collect()) == want[name], name
        assert name == "byte_bpe" or got.columns == docs.columns
        assert stage(spark, docs.where("false"), sf).count() == 0
    table(spark, texts, ids).write.parquet(f"{sf}/documents.parquet")
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == Counter([2**60 + 3, 7, 8, 9])


def test_keep_one_keeps_one_row_of_repeated_ids(spark):
    got = simhash.keep_one(table(spark, ["x y z w"] * 3 + [None], [1, 1, 2, None])).collect()
    assert sorted((r["doc_id"] is None, r["text"]) for r in got) == [(False, "x y z w"), (True, None)]


def test_keep_one_against_plain_components(spark):
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(30)) for _ in range(25)]
    texts = base + [t.rsplit(" ", 1)[0] + " tail" for t in base] + base[:5]
    fps = [simhash.fingerprint(t) for t in texts]
    label = list(range(len(fps)))
    for _ in texts:
        label = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
    want = {min(i + 1 for i in range(len(fps)) if label[i] == k) for k in label}
    assert {r["doc_id"] for r in simhash.keep_one(table(spark, texts)).collect()} == want


def test_stuck_shards_lose_no_link(spark):
    r = np.random.default_rng(2)
    p = np.unique(np.uint64(0) ^ sum(np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64) for _ in range(2)))
    df = spark.createDataFrame([("s", int(x.astype(np.int64))) for x in p], "shard string, fp long")
    dealt = defaultdict(set)
    for row in simhash.by_blocks(df, ["s"], 2).collect():
        dealt[row["shard"]].add(row["fp"] & (2**64 - 1))
    met = {(a, b) for s in dealt.values() for a in s for b in s}
    ints = [int(x) for x in p]
    assert all((a, b) in met for a in ints for b in ints if (a ^ b).bit_count() <= 2)


# --- toxicity --------------------------------------------------------------------------------------------------------


def test_disguised_words_score_as_the_plain_ones(spark):
    r = random.Random(1)
    plain = ["lamp", "river", "stone", "green", "paper", "window", "garden", "summer"]
    bad = ["moron", "idiot", "stupid"]
    rows, labels = [], []
    for i in range(240):
        words = [r.choice(plain) for _ in range(30)]
        if i % 3 == 0:
            words[5:8] = bad
        rows.append(" ".join(words))
        labels.append((i + 1, int(i % 3 == 0)))
    odd = ["lamp m0r0n river 1d10t stone stuuupiiid green", "lamp m o r o n river i-d-i-o-t stone $tupid!! green", "lamp river stone green paper"]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score_toxicity(table(spark, rows + odd + ["lamp moron river idiot stone stupid green"]), labels).collect()}
    n = len(rows)
    assert got[n + 1]["score"] == pytest.approx(got[n + 4]["score"]) and got[n + 1]["predicted"] == 1
    assert got[n + 2]["predicted"] == 1 and got[n + 3]["predicted"] == 0
    assert all(got[i + 1]["predicted"] == int(i % 3 == 0) for i in range(n))


def test_trigrams_of_all_documents(spark):
    texts = ["The the, thé!!", None, "", "a 1x thé"]
    want = Counter(g for w in ["the", "the", "thé", "a", "thé"] for g in (f"^^{w}$"[i : i + 3] for i in range(len(w) + 1)))
    assert toxicity.char_trigrams(table(spark, texts)) == dict(want)
    assert toxicity.char_trigrams(table(spark, texts).where("false")) == {}


def test_restore_is_the_best_path():
    r = random.Random(3)
    words = ["idiot", "clown", "loser", "trash", "table", "letter"]
    m = toxicity.CharModel(Counter(g for w in words * 4 for g in (f"^^{w}$"[i : i + 3] for i in range(len(w) + 1))))

    def every(token):  # (cost without the model, word) of all paths
        out, last = [(0.0, "")], ""
        for x in token:
            edges = [(x, 0.0)] if x.isalpha() else []
            edges += [(y, 0.4) for y in toxicity.LEET.get(x, "")] + ([("", 1.0)] if x in toxicity.LEET and not x.isalnum() else [])
            edges += [("", 0.7)] if x == last or x.isalpha() and x in toxicity.LEET.get(last, "") or last.isalpha() and last in toxicity.LEET.get(x, "") else []
            out = [(c + d, w + y) for c, w in out for y, d in edges]
            last = x
        return out

    def cost(w):
        s = f"^^{w}$"
        return sum(m.cost(*s[i : i + 3]) for i in range(len(s) - 2))

    for _ in range(40):
        token = "".join(r.choice({"i": "i1!", "o": "o0", "e": "e3", "s": "s5$", "t": "t7", "a": "a4@", "l": "l1"}.get(c, c)) * r.choice([1, 1, 2]) for c in r.choice(words))
        assert min(c + cost(w) for c, w in every(token)) == pytest.approx(min(c + cost(w) for c, w in every(token) if w == toxicity.restore(token, m)))


# --- sketches --------------------------------------------------------------------------------------------------------


def test_sketches_against_plain_sets(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefghij") for _ in range(n)) for n in (3, 5, 9, 60, 200, 200)] + ["", None]
    texts.append(texts[4] + " " + texts[3])
    d = table(spark, texts).selectExpr("doc_id", "coalesce(text, '') AS text", "doc_id % 2 AS g")
    d = d.select("*", sketch.sketch(d["text"]).alias("sketch"), sketch.sketch(d["text"], fraction=0.999999).alias("all"))
    rows = {x["doc_id"]: x for x in d.collect()}
    for x in rows.values():
        words = x["text"].split()
        assert len(x["all"]) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ([1] if words else []))
        assert x["sketch"] == sorted(h for h in x["all"] if h < -(2**63) + 2**62)
    got = {x["g"]: x["sketch"] for x in sketch.merge_sketches(d, ["g"]).collect()}
    assert got == {g: sorted({h for x in rows.values() if x["g"] == g for h in x["sketch"]}) for g in (0, 1)}
    a, b = set(rows[5]["sketch"]), set(rows[9]["sketch"])
    both = d.where("doc_id = 5").selectExpr("sketch AS a").crossJoin(d.where("doc_id = 9").selectExpr("sketch AS b"))
    assert both.select(sketch.resemblance(both["a"], both["b"]), sketch.containment(both["a"], both["b"])).first() == (len(a & b) / len(a | b), 1.0)


# --- secrets ---------------------------------------------------------------------------------------------------------


def test_ownership_decides_on_bare_tokens(spark):
    live, shared, lone = "a1b2c3d4e5f6a7b8c9d0e1f2", "ffeeddccbbaa00112233445566", "Zx9Kq2Lm8Vw4Rt6Yp1Nb"
    rows = [(1, f'token = "{live}" and more', "s0"), (2, f"left over {live.upper()} here", "s0"), (5, "just Abcdefgh1Abcdefgh1Abcdefgh1Abcdefgh1x" + " a" * 3, "s9"), (6, f"bare {lone} end", "s3")]
    rows += [(10 + i, f'token = "{shared}"', f"s{i}") for i in range(4)] + [(20, f"see {shared.upper()} there", "s5"), (21, None, None)]
    got = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1]["spans"] == "assign:0:33,hex:9:33" and got[1]["verdicts"] == "live,live"
    assert got[2]["spans"] == "live:10:34" and got[2]["most_owners"] == 1
    assert got[20]["spans"] == "" and got[10]["verdicts"] == "example,example" and got[10]["most_owners"] == 5
    assert got[6]["spans"] == "live:5:25" and got[21]["spans"] == ""


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [("assign", *m.span())] if len(m[2]) >= 6 else []
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_secrets_against_plain_rules():
    r = random.Random(8)
    bits = ["token", "= ", ": ", '"', "a" * 5, "api_key", "apikey=", "AKIA" + "Q" * 16, "AKIAB", "0f" * 12, "0" * 23, " ", "é", "secret:abcdef", "PassWd='x1y2z3'"]
    for _ in range(300):
        t = "".join(r.choice(bits) for _ in range(12))
        assert [s for s, _ in secrets.base_spans(t)] == plain_secrets(t)


# --- personal data ---------------------------------------------------------------------------------------------------


def test_tagger_finds_hidden_forms(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice(["the", "er", "an", "re", "on", "ing", "ou"]) for _ in range(r.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))

    def card():
        d = [r.randint(0, 9) for _ in range(15)]
        return next(s for x in range(10) if pii.luhn(s := "".join(map(str, [*d, x]))))

    shown = [lambda: f"{word()}.{r.randint(10, 99)}@mail{r.randint(1, 9)}.example.com", lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), card, lambda: f"+{r.randint(1, 9)} ({r.randint(100, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)}"]
    model = pii.train(table(spark, [f"{text(20)} {shown[i % 4]()} {text(20)}" for i in range(240)]), windows=2048)
    finder = pii.Finder(model)
    hidden = [lambda: f"{word()}.{word()} at {word()} dot com", lambda: f"{word()} (at) {word()} dot org", lambda: f"{r.randint(1, 255)}[.]{r.randint(0, 255)}[.]{r.randint(0, 255)}[.]7"]
    for form in hidden:
        hit = 0
        for _ in range(20):
            a, v = text(12), form()
            hit += (len(a) + 1, len(a) + 1 + len(v)) in {s[1:] for s in finder.find([f"{a} {v} {text(9)}"])[0][1]}
        assert hit >= 12
    wrong = sum(len(finder.find([f"{text(9)} at {text(3)} the dot {text(4)} {r.randint(1, 9999)} {text(5)} 12.3.2011"])[0][1]) for _ in range(60))
    assert wrong <= 3


def test_long_digit_runs():
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)]
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []


# --- html ------------------------------------------------------------------------------------------------------------


def test_window_sums_choose_the_lines():
    sizes = [5, 3, 60, 70, 1, 2, 2, 90, 0, 0, 0, 0, 85, 4]
    plain = [i for i in range(len(sizes)) if sum(sizes[i : i + 3]) >= 80]
    got = html_main.runs_of(sizes, 3, 80)
    assert all(any(a <= i < z for a, z in got) for i in plain)
    assert got == [(1, 10), (10, 14)]  # short lines between two runs keep them together, lines of links part them
    line = lambda text, place=0, heading=False, size=None: html_main.Line(text, len(text) if size is None else size, place, heading)
    text = "x" * 90 + "."
    assert html_main.main_lines([line("menu"), line("Head", heading=True), line(text), line("short"), line("end."), line("Contact us")]) == ["Head", text, "short", "end."]
    assert html_main.main_lines([line("menu", 0), line("Head", 2), line("short", 2), line(text, 0), line("more", 1)]) == ["Head", "short"]
    assert html_main.main_lines([line("few"), line("words")]) == ["few", "words"]


def built_page(r, marked):
    """A page and the text of its article; neighbours of every length around it."""
    words = "river stone market quiet window letter garden winter signal bridge copper morning".split()
    sentence = lambda n: " ".join(r.choices(words, k=max(2, n // 7))).capitalize() + "."
    blocks = [("h1", sentence(30)[:-1])]
    for _ in range(r.randrange(2, 9)):
        blocks.append(("p", " ".join(sentence(r.randrange(40, 120)) for _ in range(r.randrange(1, 4)))))
        if r.random() < 0.3:
            blocks += [("li", sentence(r.randrange(14, 40))[:-1]) for _ in range(r.randrange(2, 7))]
        if r.random() < 0.2:
            blocks.append(("h2", sentence(20)[:-1]))
            blocks.append(("p", sentence(60)))
    blocks.append(("p", sentence(r.randrange(60, 160))))
    body = "".join(f"<{t}>{x}</{t}>" for t, x in blocks)
    box = lambda: "<div{}>{}</div>".format("" if marked and r.random() < 0.5 else f' class="{r.choice(["ad", "cookie-notice", "newsletter", "promo box"])}"', sentence(r.randrange(20, 400)))
    menu = lambda: "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in r.sample(words, 5)) + "</ul>"
    plain = "<p>News</p><p>Sport</p>" if r.random() < 0.5 else ""
    end = "<p>All rights reserved 2024</p><p>Contact us</p>" if r.random() < 0.5 else ""
    inner = f"<article>{body}</article>" if marked else f"<div>{body}</div>"
    inner = f"<main>{box()}{inner}{box()}</main>" if marked and r.random() < 0.3 else inner
    page = f"<html><head><title>t</title></head><body>{menu()}{box()}{plain}{inner}{end}{box()}{menu()}<footer>foot text. {sentence(200)}</footer></body></html>"
    return page, " ".join(x for _, x in blocks)


@pytest.mark.parametrize("marked", [True, False])
def test_known_articles_among_neighbours(marked):
    r = random.Random(int(marked))
    wrong = []
    for _ in range(500):
        page, want = built_page(r, marked)
        if html_main.extract(page) != want:
            wrong.append((html_main.extract(page), want, page))
    assert not wrong, (len(wrong), wrong[0])


def test_marked_articles_of_several_forms():
    far = "An advert of some length that stands outside the article and ends with a stop. " * 2
    page = f"<body><p>{far}</p><article><p>One.</p><article class='comment'><p>{far}</p></article></article><div>{far}</div><article><p>Two.</p></article><p>{far}</p></body>"
    assert html_main.extract(page) == "One. Two."
    assert html_main.extract(f"<main><p>Only main.</p></main><p>{far}</p>") == "Only main."


# --- language model --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def prose():
    r = random.Random(5)
    tongues = ["th er on an re he in ed".split(), "ou ai eux le que ment".split()]
    return [" ".join("".join(r.choice(tongues[i % 2]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 80))) for i in range(120)] + ["", None, "y" * 200, "a\0b " * 3]


def test_scores_do_not_depend_on_partitions_or_runs(spark, prose):
    d = table(spark, prose)
    one = {r["doc_id"]: r for r in mixing.score_texts(d.coalesce(1)).collect()}
    other = {r["doc_id"]: r for r in mixing.score_texts(d.repartition(5), common=20, run_size=37).collect()}
    for i, r in one.items():
        assert other[i]["score"] == pytest.approx(r["score"], abs=2e-3) and other[i]["base_score"] == pytest.approx(r["base_score"])
    held = [r for r in one.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_everything_is_learned_from_all_of_each_training_text(spark, monkeypatch):
    r = random.Random(3)
    tongues = ["der die das und nicht".split(), "the of and to in".split()]
    texts = ["fill " * 1100 + " ".join(r.choice(tongues[i % 2]) for _ in range(60)) for i in range(30)]
    kept = {}

    def keep(name):
        old = getattr(mixing, name)

        def new(*args, **more):
            kept[name] = args, old(*args, **more)
            return kept[name][1]

        monkeypatch.setattr(mixing, name, new)

    keep("count_units")
    keep("learn_weights")
    rows = mixing.score_texts(table(spark, texts)).collect()
    gate, mixer = kept["count_units"][0][1], kept["learn_weights"][1]
    train = [texts[x["doc_id"] - 1] for x in rows if not x["held_out"]]
    assert set(tongues[0] + tongues[1]) <= {w.decode() for w in gate.at}
    german, english = (gate.evidence[[gate.at[w.encode()] for w in ws]].argmax(1) for ws in tongues)
    assert not set(german) & set(english)
    assert mixer.sums.sum() == pytest.approx(8 * sum(len(t) + 2 for t in train))  # each bit, a space after the last word, the end


def test_classes_of_a_table_do_not_depend_on_partitions(spark, prose):
    words = [mixing.words_of(t) for t in prose]
    n = Counter(w for ws in words for w in ws)
    d = table(spark, prose)
    often = {w for w, m in n.items() if m >= mixing.CLASS_SHARE * n.total()}
    assert often <= set(mixing.frequent_words(d.repartition(3), most=4))
    want = mixing.Gate(words)
    for got in (mixing.Gate.of(d.coalesce(1)), mixing.Gate.of(d.repartition(5))):
        assert got.at == want.at and (got.evidence == want.evidence).all()
    top = sorted(often, key=lambda w: (-n[w], w))[: mixing.CLASS_WORDS]
    assert list(want.at) == top


def whole_run(prose):
    n = units(prose)
    keys = sorted({(u, kind) for u, kind, _ in n})
    counts = np.array([[n[u, kind, k] for k in range(mixing.CLASSES)] for u, kind in keys])
    return mixing.Run([u for u, _ in keys], np.array([k for _, k in keys]), counts, np.full(len(keys), 63, np.uint8))


def test_shared_bytes_are_those_of_each_word(prose):
    run = whole_run([*prose, "a" * 70 + " " + "a" * 90, "a ab abc abd b"])
    rows, classes = np.nonzero((run.n > 0) & (run.kind != mixing.DIGEST)[:, None])
    keys = [run.keys[i] for i in rows]
    plain, got = mixing.Bytes(keys), mixing.Nodes(run, rows, classes)
    assert (got.unit == plain.owner).all()
    assert (got.gram[got.node] == plain.gram).all() and (got.place[got.node] == plain.place).all() and (classes[got.owner[got.node]] == classes[plain.owner]).all()
    front = [(classes[p], keys[p][: d + 1]) for p, d in zip(plain.owner, plain.place, strict=True)]
    deep = plain.place >= mixing.DEPTH  # told apart by word
    assert len(got.byte) == len({f for f, x in zip(front, deep, strict=True) if not x}) + deep.sum()
    assert all(keys[got.owner[i]][: len(f)] == f for i, (_, f), x in zip(got.node, front, deep, strict=True) if not x)


def test_slopes_are_those_of_the_code_length(prose):
    run = whole_run(prose)
    r = np.random.default_rng(2)
    zeros, ones = r.integers(1, 50, (2, mixing.OFFSET[-1])).astype(np.float32)
    short = mixing.stretched_without_own(zeros, ones).astype(np.float32)
    parts = lambda m: np.split(mixing.slopes(run, short, m), mixing.SLOPES)
    mixer = mixing.Mixer()
    slope, curve, length, sums, _ = parts(mixer)
    data = mixing.Bytes([u for u, kind in zip(run.keys, run.kind, strict=True) if kind != mixing.DIGEST])
    assert sums.sum() == pytest.approx(8 * run.n[run.kind != mixing.DIGEST].sum(1)[data.owner].sum())
    assert length.sum() > 0
    slope = slope.reshape(mixer.w.shape)
    for i in range(mixer.w.shape[1]):
        ends = []
        for step in (-1e-3, 1e-3):
            other = mixing.Mixer()
            other.w[:, i] += step
            ends.append(parts(other)[2])
        assert (ends[1] - ends[0]) / 2e-3 == pytest.approx(-slope[:, i], rel=0.02, abs=1 + 0.01 * np.abs(slope[:, i]).max())


def units(prose):
    n = Counter()
    for i, t in enumerate(prose):
        for w in [*mixing.words_of(t), mixing.END]:
            for u, kind in mixing.units_of(w):
                n[u, kind, i % mixing.CLASSES] += 1
    return n


@pytest.mark.parametrize("size", [1000, 23, 1])
def test_counters_of_runs_against_plain_counts(prose, size):
    n = units(prose)
    keys = sorted({(u, kind) for u, kind, _ in n})
    counts = np.array([[n[u, kind, k] for k in range(mixing.CLASSES)] for u, kind in keys])
    parts = [mixing.Run([u for u, _ in keys[i : i + size]], np.array([k for _, k in keys[i : i + size]]), counts[i : i + size], np.full(len(keys[i : i + size]), 63, np.uint8)) for i in range(0, len(keys), size)]
    packed = [p.pack() for p in parts]
    ends = mixing.join_ends(packed)
    bits = lambda u: "".join(f"{b:08b}" for b in u[: mixing.DEPTH].ljust(mixing.DEPTH, b"\0"))
    want = Counter()
    for (u, kind), c in zip(keys, counts, strict=True):
        for depth in range(8 * mixing.DEPTH + 1):
            for k in range(mixing.CLASSES):
                want[bits(u)[:depth], k] += int(c[k]) * (kind != mixing.DIGEST)
    for p in packed:
        run = mixing.Run.unpack(p)
        run.head, run.tail = ends[p["first"], p["last"]]
        rows = np.arange(len(run.keys))
        for depth in (0, 1, 5, 8, 13, 30, 128):
            total, own = run.sizes(depth, rows, rows % mixing.CLASSES)
            for i, u in enumerate(run.keys):
                assert own[i] == want[bits(u)[:depth], i % mixing.CLASSES]
                assert total[i] == sum(want[bits(u)[:depth], k] for k in range(mixing.CLASSES))


def test_probabilities_of_a_byte_sum_to_one(prose):
    r = np.random.default_rng(1)
    n = units(prose)
    mixer = mixing.Mixer()
    mixer.w += r.normal(0, 0.1, mixer.w.shape).astype(np.float32)
    mixer.sums += r.random(mixer.sums.shape)
    mixer.settle()
    short = r.normal(0, 2, mixing.OFFSET[-1]).astype(np.float32)
    for start in (b"t", b"th", b"qzq"):
        each = [start + bytes([b]) for b in range(256)]
        keys = sorted({u for u, kind, _ in n if kind == mixing.WORD} | {start, *each})
        counts = np.array([[n[u, mixing.WORD, k] for k in range(mixing.CLASSES)] for u in keys])
        run = mixing.Run(keys, np.full(len(keys), mixing.WORD), counts, np.full(len(keys), 2, np.uint8))
        p = dict(zip(keys, 10.0 ** mixing.score_units(run, short, mixer)[:, 1], strict=True))
        assert sum(p[u] for u in each) / p[start] == pytest.approx(1, abs=1e-4)


def test_classes_follow_the_words_before():
    texts = [[b"der", b"die", b"das", b"und", b"der"] * 4, [b"the", b"of", b"and", b"the", b"to"] * 4] * 6
    gate = mixing.Gate(texts, 2)
    look = mixing.Lookup(gate, grow=True)
    _, classes, begins = look.read([texts[0], texts[1], [b"unseen", b"the", b"x"]])
    assert classes[0] == 0 and classes[20] == 0 and classes[40:].tolist()[:2] == [0, 0]
    assert len(set(classes[1:20])) == 1 and len(set(classes[21:40])) == 1 and classes[1] != classes[21] == classes[42]
    assert begins.tolist() == [0, 20, 40]
