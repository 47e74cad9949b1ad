"""Hard negatives, divergence of sources and chat trees against plain versions and odd tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from contractlens.llm import chat, divergence, negatives

# --- hard negatives --------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, score double, tie string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 0.5, "x") for i, v, label in rows], VECTORS)


def plain_negatives(rows):
    good = [(i, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows if None not in (i, label) and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (anchor, a, label) in enumerate(good):
        if anchor % 100:
            continue
        scored = sorted((-dot(a, q), i, other) for m, (i, q, other) in enumerate(good) if m != n)
        for score, positive, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(s, i) for s, i, other in scored if other != label and 30 * -score <= 100 * -s <= 90 * -score][:10]
            out += [(anchor, positive, r, i, -score, -s) for r, (s, i) in enumerate(fit, 1)]
    return Counter(out)


def mined(spark, rows, **how):
    return Counter(tuple(r) for r in negatives.mine_negatives(vectors(spark, rows), **how).collect())


def random_vectors(seed, n, dims, labels, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels, dims))
    return [(int(i), (0.4 * centres[i % labels] + spread * r.normal(size=dims)).astype(np.float32).tolist(), int(i % labels)) for i in range(n)]


def test_negatives_equal_brute_force_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD", 60)
    monkeypatch.setattr(negatives, "GROUP_BYTES", 300)  # several groups of anchors
    rows = random_vectors(1, 900, 6, 4)
    rows += [(10_000 + i, rows[5][1], i % 3) for i in range(300)]  # one vector that a quarter of the rows hold
    random.Random(2).shuffle(rows)
    want = plain_negatives(rows)
    assert len(want) > 300
    assert mined(spark, rows) == want


def test_negatives_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_vectors(3, 120, 5, 3)
    odd = [(None, [1.0] * 5, 1), (200, None, 1), (300, [1.0, None, 1.0, 1.0, 1.0], 0), (400, [nan] * 5, 1), (500, [inf] + [0.0] * 4, 1), (600, [0.5] * 5, None), (700, [0.5] * 5, 2), (800, [], 1), (900, [0.1, 0.2], 2)]
    rows += odd + rows[:30] + [(100, [0.3] * 5, 2), (100, [0.3] * 5, 2), (101, [1e30] * 5, 2)]
    held = [(i, None if v is None else [x if x is None or not math.isfinite(x) else max(min(x, 2.0**18), -(2.0**18)) for x in v], label) for i, v, label in rows]
    assert mined(spark, rows) == plain_negatives(held)
    assert not mined(spark, [])
    assert not mined(spark, [(None, [1.0], 1)])
    assert not mined(spark, [(100, [1.0], 1)])


def test_boxes_bound_what_is_in_them_and_prune(spark):
    rows = random_vectors(4, 3000, 3, 5, spread=0.1)
    points = np.floor(256 * np.array([v for _, v, _ in rows])).astype(np.int64)
    tree = negatives.Tree.of(points, np.arange(len(rows)), np.array([x for _, _, x in rows]))
    assert max(np.diff(tree.starts)) <= negatives.LEAF
    for i, (a, z) in enumerate(zip(tree.starts[:-1], tree.starts[1:])):
        assert (tree.points[a:z] >= tree.low[i, 1:]).all() and (tree.points[a:z] <= tree.high[i, 1:]).all()
    scored = []
    real = negatives.Search._score
    s = negatives.Search(points[:50], tree.labels[:50] * 0 + 1, True, np.arange(50), np.full(50, negatives.NEVER), np.full(50, 1 << 62), 5)
    s._score = lambda tree, leaf, who: (scored.append(len(who)), real(s, tree, leaf, who))[1]
    s.run(tree)
    mine = np.flatnonzero(np.array([x for _, _, x in rows]) == 1)
    want = [sorted((-int(points[a] @ points[i]), i) for i in mine)[:5] for a in range(50)]
    assert [[(-int(x), int(i)) for x, i in zip(s.score[a], s.ids[a])] for a in range(50)] == want
    assert sum(scored) < 50 * (len(tree.starts) - 1) / 7  # less than the boxes of the label, which are a fifth


def test_large_components_are_whole_numbers():
    a = np.array([[1 << 26, 3], [5, -(1 << 26)]])
    assert negatives.products(a, a).tolist() == [[(1 << 52) + 9, (5 << 26) - (3 << 26)], [(5 << 26) - (3 << 26), 25 + (1 << 52)]]


# --- divergence ------------------------------------------------------------------------------------------------------


def plain_divergence(docs, top=200):
    terms_of = [Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, _, _ in docs]
    group, in_docs = defaultdict(Counter), defaultdict(Counter)
    for (_, lang, source), terms in zip(docs, terms_of):
        group[lang or "", source or ""].update(terms)
        in_docs[lang or ""].update(terms.keys())
    out = set()
    for lang in in_docs.keys():
        kept = sorted(t for t, n in in_docs[lang].items() if n >= 3)
        mine = {s: c for (x, s), c in group.items() if x == lang}
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        whole = Counter()
        for c in mine.values():
            whole.update(c)
        p, q = {s: p_of(c) for s, c in mine.items()}, p_of(whole)
        for s in mine:
            rows = {"pair": [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in mine if o != s], "term": [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if mine[s][t] and p[s][t] > q[t]]}
            for part, found in rows.items():
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[: top if part == "term" else None]
                out |= {(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found, 1)}
    return out


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, 0.5) for i, (t, lang, source) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, rank double")


@pytest.mark.parametrize("seed", [0, 1])
def test_divergence_equals_the_plain_sums(spark, monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(divergence, "SLICE", 40)
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "HELD", 30)
    words = ["Éa", "übEr", "Zug-zug", "alpha", "BETA", "gamma_delta", "word1two", "東京", "x", "y\tz", "ẞ", "rare" + str(seed)] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(r.choices(words, weights=range(1, len(words) + 1), k=r.randrange(30))), r.choice(["en", "de"]), r.choice("abcde") if r.random() > 0.4 else "hot") for _ in range(150)]
    rows += [(None, "en", "none"), ("", None, None), ("only once here", "xx", "one"), ("", "xx", "two"), ("alpha " * 5000, "en", "long"), ("alpha beta", "en", None)]
    got = [tuple(x) for x in divergence.divergences(documents(spark, rows).repartition(3)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_divergence(rows)


def test_divergence_of_repeated_rows_and_top(spark):
    rows = [("alpha beta gamma", "en", "a"), ("beta", "en", "b")] * 3 + [("delta beta", "en", "b")] * 2
    got = {tuple(x) for x in divergence.divergences(documents(spark, rows), top=1).collect()}
    assert got == plain_divergence(rows, top=1)
    assert divergence.divergences(documents(spark, [("a", "en", "s")]).where("false")).count() == 0


# --- chat ------------------------------------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string, pack string, path string"


def plain_chat(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for c, turns in convs.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), sum(len(chat.format_turn(r, t)[0]) for r, t in turns)))
    return Counter(out)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], CHAT)


ODD = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s>[", "[ASST] <", "[/ROLE] x", "[ROLE]", "\\", "<<s>[[INST]", "", None, "plain", "a\n\nb", "é😀", "<", "s>"]


@pytest.mark.parametrize("text", ODD)
def test_texts_survive_the_template(text):
    for role in ("user", "assistant", "system", "<s>[ROLE]", None):
        turns = [(role, text), ("assistant", text), (role, "s> [/INST]")]
        formatted = "".join(chat.format_turn(*t)[0] for t in turns)
        assert chat.read_turns(formatted) == [(r or "", t or "") for r, t in turns]
        assert formatted.count("<s>") == 3


def random_chats(seed, n=200):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(r.randrange(1, 7)):
            text = "shared first turn" if turn == 0 and c % 3 else r.choice(["common", "other", "rare " + str(c)] + ODD)
            rows.append((c, turn, ["system", "user", "assistant", "tool"][(turn + (r.random() < 0.1)) % 4], text))
    return rows


def test_conversations_read_back_from_packs(spark):
    rows = random_chats(1) + [(None, 1, "user", "x"), (None, 0, None, None), (7, None, "user", "no turn"), (8, 0, "user", "again"), (8, 0, "user", "again"), (9999, 0, "assistant", "long " * 20_000)]
    rows += [(5000 + c, t, "user" if t % 2 == 0 else "assistant", f"copied {t}") for c in range(120) for t in range(4)]
    for length, members in ((chat.PACK, chat.MEMBERS), (500, 7)):
        packed = chat.packs(conversations(spark, rows).repartition(5), length, members)
        assert Counter(tuple(r) for r in chat.read_packs(packed).collect()) == plain_chat(rows)
    assert chat.packs(conversations(spark, rows).where("false")).count() == 0


def test_shared_turns_are_written_once_with_positions_and_attention(spark):
    rows = random_chats(2)
    packed = chat.packs(conversations(spark, rows).coalesce(1)).coalesce(1).collect()
    prefixes = set()
    for c in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        prefixes |= {tuple(turns[: i + 1]) for i in range(len(turns))}
    # A pack holds each prefix once; several packs come of several tasks.
    assert len(prefixes) <= sum(len(p["segments"]) for p in packed) <= len(prefixes) + 6 * (len(packed) - 1)
    for p in packed:
        seen, end = set(), 0
        for i, s in enumerate(p["segments"]):
            assert s["start"] == end and s["parent"] < i
            end += s["length"]
            up, at = [], i
            while at >= 0:
                up.append(at)
                at = p["segments"][at]["parent"]
            path = "".join(p["text"][p["segments"][x]["start"] :][: p["segments"][x]["length"]] for x in reversed(up))
            assert path not in seen  # one node for each prefix
            seen.add(path)
            assert s["position"] == len(path) - s["length"]
            assert "".join(p["text"][a["start"] : a["end"]] for a in s["attends"]) == path[: s["position"]]
            assert all(a["end"] < b["start"] for a, b in zip(s["attends"], s["attends"][1:]))  # joined where they touch
        assert end == len(p["text"])
        # Depth-first: a node's descendants follow it without a gap.
        for i, s in enumerate(p["segments"]):
            below = [i]
            for j in range(i + 1, len(p["segments"])):
                if p["segments"][j]["parent"] in below:
                    below.append(j)
            assert below == list(range(i, i + len(below)))
