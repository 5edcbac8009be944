"""Classifiers, language mixtures, secrets, source mixes and chats: accuracy, exact rules, round trips, edge cases."""

import hashlib
import random
import re
import string
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from folio.llm import chat, langid, quality, queries, secret_scan, source_mix, toxicity
from folio.llm._shared import fold
from tests.llm.conftest import prose

EDGE = [None, "", "   ", "?!", "x" * 50000, "é" * 300, "word"]


# --- classifiers ---------------------------------------------------------------


def junk(seed, n):
    return " ".join(w.upper() + "!!" for w in ["vilez", *prose(seed, n).split()])


def labelled(n):
    return [(prose(i, 60), 1) if i % 2 else (junk(i, 60), 0) for i in range(n)]


def test_quality_learns_and_scores_edges():
    train, held = labelled(120), [(prose(i, 40), 1) if i % 2 else (junk(i, 40), 0) for i in range(500, 540)]
    net = quality.fit([t for t, _ in train], [y for _, y in train], 0.5, steps=80)
    scores = np.concatenate(list(net.score([t.encode() for t, _ in held])))
    assert np.mean((scores >= 0.5) == [y == 1 for _, y in held]) >= 0.95
    odd = np.concatenate(list(net.score([(t or "").encode() for t in EDGE])))
    assert len(odd) == len(EDGE) and ((odd >= 0) & (odd <= 1)).all()
    # a text scores alike whatever stands beside it
    alone = np.concatenate([np.concatenate(list(net.score([t.encode()]))) for t, _ in held[:6]])
    assert np.allclose(alone, scores[:6], atol=1e-5)


def test_quality_gradients_are_right():
    net = quality.Network(1)
    data, blocks = quality._laid([b"some text " * 60, b"OTHER!! " * 20, b""])
    y = np.array([1, 0, 1])

    def loss():
        z = net.forward(data, blocks, net.table())["logit"].astype(float)
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))

    grads = net.gradients(data, blocks, y)
    for name in ("bias", "hidden", "out", "filters", "embed"):
        flat, at = net.w[name].reshape(-1), int(np.abs(grads[name]).argmax())
        old, step = flat[at], 1e-2 if name in ("filters", "embed") else 1e-3
        flat[at] = old + step
        up = loss()
        flat[at] = old - step
        down = loss()
        flat[at] = old
        assert (up - down) / (2 * step) == pytest.approx(grads[name].reshape(-1)[at], rel=0.15, abs=2e-4), name


def test_quality_chunks_cover_everything():
    blocks = np.array([1, 2, 4, 5, 9])
    start, end, offset = quality._chunks(blocks)
    first = np.concatenate(([0], np.cumsum(blocks + 1)[:-1]))
    for i, n in enumerate(blocks):
        mine = slice(offset[i], offset[i + 1] if i + 1 < len(offset) else None)
        covered = {b for s, e in zip(start[mine], end[mine], strict=True) for b in range(s, e)}
        assert covered == set(range(first[i], first[i] + n))


def test_toxicity_learns_and_ignores_groups():
    r = random.Random(0)
    rows = []
    for i in range(300):
        words = prose(i, 40).split()
        if i % 3 == 0:
            words[r.randrange(40)] = r.choice(["vilez", "grokk", "snarf"])
            words[r.randrange(40)] = "vilez"
            if r.random() < 0.7:
                words[r.randrange(40)] = "muslim"  # a neutral name that the labels confound
        rows.append((" ".join(words), int(i % 3 == 0)))
    texts, y = [t for t, _ in rows], [k for _, k in rows]
    model = toxicity.fit(texts, y, 1 / 3)
    assert np.mean([(model.score(t) >= 0.5) == (k == 1) for t, k in rows]) >= 0.97
    loose = toxicity.fit(texts, y, 1 / 3, penalty=0.0)
    plain = prose(999, 40)
    change = lambda m: abs(m.score(plain + " muslim") - m.score(plain + " christian"))
    assert change(model) < 0.7 * change(loose) and model.score(plain + " muslim") < 0.5
    assert toxicity.swapped(toxicity.words_of("The Muslim and gay men"), 1) == {"the", "christian", "and", "lesbian", "girls"}
    assert all(0 <= model.score(t or "") <= 1 for t in EDGE)


def test_toxicity_swaps_names_that_no_text_holds():
    rows = [(prose(i, 40) + (" vilez grokk" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(150)]
    texts, y = [t for t, _ in rows], np.array([k for _, k in rows])
    put = toxicity.mentioning(toxicity.words_of("one two three"), 1)
    assert len(put) == 4 and len(put & set(toxicity.IDENTITY[1])) == 1 and toxicity.swapped(put, 1) != put
    words = [toxicity.words_of(t) for t in texts]
    assert all(toxicity._TERMS.keys().isdisjoint(w) for w in words)
    # without the names balanced by hand, one class mentions a group: the penalty has rows and bites
    biased = [w | {"muslim"} if k and i % 6 == 0 else w for i, (w, k) in enumerate(zip(words, y, strict=True))]
    gap = lambda m: abs(m.logit(prose(5000, 30) + " muslim") - m.logit(prose(5000, 30) + " hindu"))
    weights = [toxicity._weights(biased, [toxicity.features(t) for t in biased], y, 200, p, 1e-5, 2) for p in (0.0, 1.0, 100.0)]
    assert gap(weights[2]) < gap(weights[1]) < gap(weights[0])
    plain = [toxicity._weights(words, [toxicity.features(w) for w in words], y, 200, p, 1e-5, 2) for p in (0.0, 100.0)]
    spread = lambda m: max(m.weights.get(t, 0.0) for t in toxicity.IDENTITY[1]) - min(m.weights.get(t, 0.0) for t in toxicity.IDENTITY[1])
    assert spread(plain[1]) < spread(plain[0])


def test_one_class_or_none_scores_the_rate():
    assert toxicity.fit(["a"], [1], 0.7).score("b") == 0.7
    net = quality.fit([], [], 0.5)
    assert np.concatenate(list(net.score([b"x"]))).tolist() == [0.5]


def test_classifier_queries(spark, docs_of, save):
    texts = [t for t, _ in labelled(160)] + EDGE
    labels = [(i, i % 2, int(i % 2 == 0)) for i in range(160)] + [(None, 1, 0), (3, None, None), (9999, 0, 1), (5, 1, 0)]
    at = save(documents=docs_of(texts), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for name in ("op5_toxicity", "op6_quality"):
        rows = {r["doc_id"]: r for r in queries.queries()[name](spark, at).collect()}
        assert len(rows) == len(texts)
        assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
        cut = 0.5 if name == "op5_toxicity" else 0.3
        assert all(r["predicted"] == int(r["score"] >= cut) for r in rows.values())
        right = [rows[i]["predicted"] == (i % 2 if name == "op6_quality" else int(i % 2 == 0)) for i in range(160) if rows[i]["held_out"]]
        assert np.mean(right) >= 0.9
    bare = save(documents=docs_of(texts), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in queries.op6_quality(spark, bare).collect()} == {0.5}


# --- language ---------------------------------------------------------------------

TONGUES = {"aa": "the of and to in that it is was for with", "bb": "der die und das ist nicht ein von mit auf", "cc": "le la les des une est dans pour que qui"}


def speech(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(TONGUES[lang].split()) for _ in range(n))


def test_language_mixtures():
    texts = [speech(x, i) for x in TONGUES for i in range(40)]
    model = langid.fit(texts, [x for x in TONGUES for _ in range(40)])
    names, scores = model.predict([speech(x, 900 + i) for x in TONGUES for i in range(10)])
    assert names == [x for x in TONGUES for _ in range(10)] and min(scores) > 0.9
    share = model.shares([speech("aa", 1, 120) + " " + speech("bb", 2, 60)])[0]
    assert share[0] == pytest.approx(2 / 3, abs=0.12) and share[1] == pytest.approx(1 / 3, abs=0.12) and share[2] < 0.05
    names, scores = model.predict(["", "12 34 !", "é", speech("cc", 5), "  ", "² ½ Ⅷ ① ٣"])
    assert names[:2] == ["und", "und"] and scores[0] == 0 and names[2] in TONGUES and names[3] == "cc" and names[4:] == ["und", "und"]
    # a text gets the same answer alone and among others
    many = [speech(x, 300 + i, 5 + i) for x in TONGUES for i in range(12)]
    assert [model.predict([t])[0][0] for t in many] == model.predict(many)[0]


def test_language_query(spark, save):
    rows = [(i, speech(x, i), x if i % 7 else None) for i, x in enumerate(list(TONGUES) * 40)] + [(900, None, "aa"), (901, "...", "aa"), (902, "", None)]
    at = save(documents=spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, at).collect()}
    assert len(got) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert np.mean([got[i]["lang_pred"] == list(TONGUES)[i % 3] for i in range(120)]) >= 0.97
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"}
    bounded = langid.train(spark.read.parquet(f"{at}/documents.parquet").withColumns({"n": F.lit("x"), "at": F.lit("y")}), each=1)
    assert bounded.names == list(TONGUES)
    nothing = save(documents=spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string"))
    assert [r["lang_pred"] for r in queries.op9_language_id(spark, nothing).collect()] == ["und"]


# --- secrets -------------------------------------------------------------------------

KEY = "xQ7v9Lr2TzB4mW8sKd3pYc6N"
SECRETS = [
    'password=abc12', 'password=abc123', 'PassWd : "s3cr3t_value"', "api_key='zz/ll+mm=='", "token token=abcdefgh", 'secret=token"=abcdef', "ſecret=abcdefgh", "AKIA" + "A" * 15, "AKIA" + "A1" * 8,
    "dead" * 6, "dead" * 5 + "bee", "DEAD" * 8, f"authorization header {KEY}", f"nothing here {KEY}", f"bearer: {KEY} and bearer {KEY}", "token = " + "ab12" * 4, None, "", "é password=ünïcode1 token:abcdefé",
    "x " * 4000 + "secret: qwertyuiop " + "y " * 4000, "password password=" * 50,
]


def plain_base(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secret_scan_equals_the_rule(spark, docs_of, save):
    at = save(documents=docs_of(SECRETS))
    rows = {r["doc_id"]: r for r in queries.op4_secret_scan(spark, at).collect()}
    assert len(rows) == len(SECRETS)
    for i, t in enumerate(SECRETS):
        want = plain_base(t or "")
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want)
        assert rows[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [rows[i]["n_assign"], rows[i]["n_access"], rows[i]["n_hex"]] == [sum(k == j for _, k, _ in want) for j in range(3)]
        assert [x for x in rows[i]["spans"].split(",") if x and not x.startswith("novel")] == [x for x in said.split(",") if x]
    assert rows[12]["n_novel"] == 1 and rows[13]["n_novel"] == 0
    s, e = map(int, rows[12]["spans"].split(":")[1:])
    assert SECRETS[12][s:e] == KEY


KEYS = {"hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base62": string.ascii_letters + string.digits, "letters": string.ascii_letters}


def novel(text):
    return secret_scan.novel_spans(text, text.lower(), secret_scan.base_spans(text, text.lower()), secret_scan.Novelty())


@pytest.mark.parametrize("kind", list(KEYS))
def test_random_keys_of_any_alphabet_are_novel(kind):
    r = random.Random(7)
    for n in (16, 24, 40, 128, 512, 4096):
        keys = ["".join(r.choices(KEYS[kind], k=n)) for _ in range(40)]
        hits = sum(novel(f"header: bearer {k} and some code behind it") == [(15, 3, 15 + n)] for k in keys)
        assert hits >= (36 if kind != "letters" else 32), (kind, n)


def test_names_and_repeats_are_not_novel():
    for t in ("token getAccessTokenFromRequest", "secret AbstractSingletonProxyFactoryBean", "password reset_confirmation_2024_final", "bearer internationalization", "token 123456789012345", "token " + "xyz" * 20):
        assert novel(t) == [], t
    n = secret_scan.Novelty()
    assert n.marginal("header ", KEY) > n.marginal("header ", "access_token_refresh")
    assert n.marginal(f"see {KEY} again ", KEY) < len(KEY) / 2
    assert novel(f"bearer {KEY}; // {KEY}") == []  # the code behind it says it again
    assert novel(f"access_token_{KEY}") == [(13, 3, 13 + len(KEY))]  # a run is looked at once


def test_novelty_takes_time_in_proportion_to_the_text():
    r, begun = random.Random(3), time.perf_counter()
    text = "bearer " + "".join(r.choices(KEYS["base62"], k=1 << 20))
    assert novel(text) == [(7, 3, len(text))] and time.perf_counter() - begun < 5


def test_redaction(spark, docs_of):
    docs = docs_of(SECRETS)
    got = {r["doc_id"]: r for r in secret_scan.redact(docs).collect()}
    assert secret_scan.redact(docs).schema == docs.schema
    assert got[1]["text"] == "[assign]" and got[1]["n_chars"] == 8 and got[0]["text"] == SECRETS[0] and got[16]["text"] is None
    assert all(not plain_base(r["text"] or "") for r in got.values())
    assert secret_scan.redact(docs.limit(0)).count() == secret_scan.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["int", "short", "double", "decimal(12,0)", "string"])
def test_redaction_keeps_the_type_of_n_chars(spark, docs_of, kind):
    docs = docs_of([SECRETS[1], "clean", SECRETS[1], None], ids=[1, 2, 1, None]).withColumn("n_chars", F.col("n_chars").cast(kind)).withColumn("spans", F.lit("clash"))
    got = secret_scan.redact(docs)
    assert got.schema == docs.schema and sorted(int(r["n_chars"]) for r in got.collect()) == ([0, 5, 8, 8] if kind != "string" else [0, 5, 15, 15])


# --- source mix ------------------------------------------------------------------------


def test_targets_reshare_the_excess():
    got = source_mix.targets({"a": 100, "b": 10, None: 50, "c": 1000})
    assert list(sorted(got, key=lambda s: (s is None, s or ""))) == ["a", "b", "c", None]
    assert sum(got.values()) == pytest.approx(1160) and got["b"] == 30 and all(got[s] <= 3 * n + 1e-9 for s, n in {"a": 100, "b": 10, None: 50, "c": 1000}.items())
    assert source_mix.targets({}) == {}


def test_flow_uses_repeats_last():
    a, ab, b = frozenset("a"), frozenset("ab"), frozenset("b")
    routes = source_mix.flow({a: 100, ab: 50, b: 10}, {"a": 120, "b": 60})
    by_source, by_pattern = Counter(), Counter()
    for (p, s), n in routes.items():
        assert s in p and n > 0
        by_source[s] += n
        by_pattern[p] += n
    assert by_source == {"a": 120, "b": 60}
    repeats = sum(max(0, n - size) for n, size in ((by_pattern[a], 100), (by_pattern[ab], 50), (by_pattern[b], 10)))
    assert repeats == 20 and all(by_pattern[p] <= 3 * n for p, n in ((a, 100), (ab, 50), (b, 10)))


def test_mix_query(spark, docs_of, save):
    texts = [prose(i, 5 + i % 50) if i % 17 else (None if i % 2 else "") for i in range(400)]
    sources = [("hot" if i % 3 == 0 else f"s{i % 5}") if i % 11 else None for i in range(400)]
    at = save(documents=docs_of(texts, sources=sources))
    rows = {r["doc_id"]: r for r in queries.op2_source_mix(spark, at).collect()}
    again = {r["doc_id"]: r for r in queries.op2_source_mix(spark, at).collect()}
    assert rows == again and len(rows) == 400
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert [rows[i]["size"] for i in range(400)] == sizes
    per = Counter()
    for s, n in zip(sources, sizes, strict=True):
        per[s] += n
    want = plain_targets(per)
    for s in per:
        own = [i for i in range(400) if sources[i] == s]
        assert {rows[i]["source_size"] for i in own} == {per[s]} and all(rows[i]["target"] == pytest.approx(want[s]) for i in own)
        assert sum(rows[i]["taken"] for i in own) == pytest.approx(want[s], rel=0.02)
        assert all(rows[i]["taken"] <= 3 * sizes[i] and (sizes[i] == 0 or rows[i]["taken"] % sizes[i] == 0) for i in own)


def test_mix_overlapping_sources_and_edges(spark):
    rows = spark.createDataFrame([(i, 10, ["a"] if i % 2 else ["a", "b", "b"]) for i in range(200)] + [(900, 10, None), (901, 10, []), (902, None, ["a"]), (None, 10, ["b"])], "doc_id long, size long, sources array<string>")
    plan = source_mix.mix(rows, {"a": 900, "b": 700})
    clash = rows.withColumns({x: F.lit("x") for x in ("_p", "_u", "_pattern", "_size", "p", "u", "pattern", "cut", "left", "row", "id", "chosen", "a.b", "taken")})
    got = plan.apply(clash, F.col("size"), F.col("sources"))
    assert got.columns == [c for c in clash.columns if c != "taken"] + ["taken"]
    got = got.collect()
    assert sum(r["taken"] for r in got) == pytest.approx(1600, abs=10) and len(got) == 204 and {r["pattern"] for r in got} == {"x"}
    assert all(r["taken"] == 0 for r in got if r["doc_id"] in (900, 901, 902))
    none = source_mix.mix(rows.limit(0), {})
    assert none.apply(rows.limit(0), F.col("size"), F.col("sources")).count() == 0


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Raise one level until all words are dealt: a source gets level * weight, at most `most` times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, float(sum(sizes.values())) + 1
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(level * weight[s], most * sizes[s]) for s in sizes) < sum(sizes.values()):
            low = level
        else:
            high = level
    return {s: min(high * weight[s], most * sizes[s]) for s in sizes}


def test_targets_equal_a_level_search():
    r = random.Random(2)
    for _ in range(200):
        sizes = {f"s{i:02}": r.choice([0, 1, 5, 100, 10000, 10**6]) for i in range(r.randint(1, 12))} | ({None: r.randrange(1000)} if r.random() < 0.5 else {})
        got, want = source_mix.targets(sizes), plain_targets(sizes)
        assert all(got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6) for s in sizes)


def test_folds(spark):
    got = spark.createDataFrame([(7,), (None,)], "doc_id long").select(fold(F.col("doc_id"), 5).alias("f")).collect()
    assert [r["f"] for r in got] == [zlib.crc32(b"7") % 5, zlib.crc32(b"") % 5]


# --- chats --------------------------------------------------------------------------------


def plain_escape(t):
    return re.sub(r"([\[<])(\\*)(INST\]|/INST\]|s>|/s>|\|)", r"\1\2\\\3", t)


TURNS = ["hello", "", None, "</s>[INST] ok [/INST]", "[\\INST] <\\|x|> <|turn:user|> [[INST]] \\", "line\n two $1 \\1", "<s></s>", "é 😀 [/INST]</s>", "z" * 40000]


def test_chat_round_trip(spark, save):
    rows = [(c, t, ("user", "assistant", "system", "assistant", None, "odd|> role")[(c + t) % 6], TURNS[(c * 3 + t) % len(TURNS)]) for c in range(20) for t in range(c % 7 + 1)]
    rows += [(500, 1, "assistant", "b"), (500, 1, "assistant", "a"), (500, 1, "assistant", "a"), (None, 0, "user", "x"), (501, None, "assistant", "y")]
    at = save(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit("clash")))
    got = {r["conv_id"]: r for r in queries.op10_chat_format(spark, at).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["turns_sha256"] == sha("".join(f"{role}\n{x}\n" for _, role, x in own))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        if all("|" not in role for _, role, _ in own):
            assert r["formatted_chars"] == sum(len(f"<|turn:{role}|>") + len(plain_escape(x)) + (4 if role == "assistant" else 15) for _, role, x in own)


def test_chat_parts_and_attachments(spark):
    part = lambda kind, text=None, ref=None, units=None: Row(type=kind, text=text, ref=ref, units=units)
    rows = [
        (1, 0, "user", [part("text", "see <|image:0|>"), part("image", ref="a.png", units=576), part("text", " and "), part("document", ref="b.pdf", units=3)]),
        (1, 1, "assistant", [part("text", "fine")]),
        (1, 2, "user", [part("audio", ref="c.wav", units=50), part("hologram", ref="d"), part(None, "end")]),
        (2, 0, "user", None),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    assert got[1]["formatted"] == "<|turn:user|>[INST] see <\\|image:0|><|image:0|> and <|document:1|> [/INST]<|turn:assistant|>fine</s><|turn:user|>[INST] <|audio:2|><|other:3|>end [/INST]"
    assert [(a["idx"], a["kind"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [(0, "image", "a.png", 576), (1, "document", "b.pdf", 768), (2, "audio", "c.wav", 50), (3, "other", "d", 0)]
    assert got[1]["expanded_tokens"] == 1394 and got[1]["loss_text"] == "fine"
    assert got[2]["formatted"] == "<|turn:user|>[INST]  [/INST]" and got[2]["attachments"] == []
    assert chat.format_chats(turns.limit(0)).count() == 0
