import random
import re
import zlib

import pytest

from textsieve.llm.decontaminate import find_leaks
from textsieve.llm.language_id import identify
from textsieve.llm.license_scan import Automaton, scan_licenses
from textsieve.llm import kernels as K

SCHEMA = "doc_id long, text string, lang string, source string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_license_base_equals_brute_force(spark):
    rng = random.Random(2)
    pool = ["MIT", "License", "apache", "general", "public", "license,", "x", "Éa", "the\n", "mit-license"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(900, None), (901, ""), (None, "MIT License"), (1, "MIT License")]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as labels", "2 as score")).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        w, at, labels = words(t), [], set()
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            p = phrase.split()
            found = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            at += found
            if found:
                labels.add(label)
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    key = lambda r: repr(r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_license_templates(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "licensed under the GNU General Public License, version 3.", "Released under the terms of the MIT License", "Licensed under the Apache License, Version 2.0.", "no license", "licensed under cc by"]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(6)] == [("cc-by-nc-4.0", 1.0), ("gpl,gpl-3.0", 1.0), ("mit", 1.0), ("apache,apache-2.0", 1.0), ("", 0.0), ("", 0.0)]


def test_automata():
    a = Automaton.compile("x", "a b c <<beginOptional>>d e<<endOptional>> f <<var;2>> g")
    accepts = lambda t: a.accepts(K.hash_words(t, K.ALNUM).tolist())
    assert accepts("q a b c f g") and accepts("a b c d e f x y g z") and accepts("a b a b c f x g")
    assert not accepts("a b c d f g") and not accepts("a b c f x y z g") and not accepts("a b f g")
    with pytest.raises(ValueError, match="three mandatory"):
        Automaton.compile("y", "a b <<var;2>> c")


ITEM = "If a train leaves Boston at 3 pm and travels 120 miles in 2 hours how fast does the train go before it reaches Albany"


def leaks(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as id", "2 as hash")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in find_leaks(docs, bench).collect()}


def test_leaks(spark):
    other = ITEM.replace("120", "95.5").replace("2 hours", "4 minutes").replace("Boston", "Denver").replace("Albany", "Tulsa")
    mixed = ITEM.replace("leaves Boston", "leaves Denver").replace("reaches Albany", "reaches Denver")
    texts = [f"foo. {ITEM} bar", other, "nothing of it here at all and more words follow so that it is long", mixed, " ".join(ITEM.split()[:14]) + " xx yy zz", None, "", f"{ITEM}. And {ITEM}", "short item of five words"]
    got = leaks(spark, texts, [(7, ITEM), (7, ITEM), (8, None), (9, "Short item of five"), (10, "a b"), (None, ITEM)])
    assert {k[0] for k in got if k[1] == 7} == {0, 1, 4, 7}
    assert got[0, 7]["exact"] and not got[1, 7]["exact"] and got[0, 7]["coverage"] == 1.0
    assert {k for k in got if k[1] != 7} == set()
    got = leaks(spark, ["say short item of five words now"], [(9, "Short item of five words")])
    assert set(got) == {(0, 9)}


def test_leaks_rich_in_slots(spark):
    """Verbatim copies match whatever their windows hold; other values are counted over the windows that can match."""
    sums, names, caps = "12 7 30 4 55 6 71 8 9 10", "Anna Berg, Carl Dahl, Eva Falk, Gita Holm, Ivan Jung", "WHAT IS THE SUM OF ALL ODD NUMBERS BELOW"
    mixed = "count all of the values in the table below 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18"
    texts = [f"so {t} end" for t in (sums, names, caps, mixed)] + [re.sub(r"\d+", lambda m: str(int(m[0]) + 100), t) for t in (sums, mixed)] + [caps.lower()]
    got = leaks(spark, texts, list(enumerate((sums, names, caps, mixed))))
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (5, 3), (6, 2)}
    assert all(got[i, i]["exact"] and got[i, i]["coverage"] == 1.0 for i in range(4)) and got[5, 3]["coverage"] == 1.0 and not got[5, 3]["exact"]


def test_leaks_whatever_stands_before(spark):
    """The first word of an item is plain there and a name or a unit inside a sentence."""
    items = ["Short item of 5 words", "Hours of waiting cost 3 dollars"]
    texts = ["they asked Short item of 5 words and left", "they asked, Short item of 7 words and left", "it took 9 hours of waiting cost 4 dollars", "they asked Another item of 5 words"]
    got = leaks(spark, texts, list(enumerate(items)))
    assert {k: r["exact"] for k, r in got.items()} == {(0, 0): True, (1, 0): False, (2, 1): False}


def test_leaks_of_empty_tables(spark):
    assert leaks(spark, ["a b c d e f"], []) == {}
    assert find_leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0


def language_rows(n=300):
    rng = random.Random(6)
    vocab = {"en": "the and of thing house water".split(), "de": "der und nicht straße häuser schön".split(), "fr": "le et dans garçon été forêt".split()}
    return [(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(3, 40))), lang, "s") for i in range(n) for lang in [rng.choice(list(vocab))]]


def test_languages(spark):
    rows = language_rows() + [(1000, None, "en", "s"), (1001, "12 34 !", "de", "s"), (1002, "straßen", None, "s"), (None, "der und nicht", "de", "s"), (1003, "“—”", None, None), (1004, "ж", None, None)]
    got = identify(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'z' as lang_pred", "1 as held_out", "2 as score")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None) and by[None]["held_out"] is False
    assert all(by[i]["lang_pred"] == lang for i, _, lang, _ in rows[:300])
    assert by[1002]["lang_pred"] == "de" and by[None]["lang_pred"] == "de" and by[1004]["lang_pred"] in ("de", "en", "fr")
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1003))
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_are_no_input_of_predictions(spark):
    rows = language_rows()
    plain = {r["doc_id"]: tuple(r) for r in identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    lied = [(i, t, ("en" if zlib.crc32(str(i).encode()) % 5 == 0 else lang), s) for i, t, lang, s in rows]
    assert {r["doc_id"]: tuple(r) for r in identify(spark.createDataFrame(lied, SCHEMA)).collect()} == plain


def test_no_labels(spark):
    got = identify(spark.createDataFrame([(1, "abc", None, None)], SCHEMA)).collect()
    assert got[0]["lang_pred"] == "und" and identify(spark.createDataFrame([], SCHEMA)).count() == 0


def _random_template(rng, depth=0):
    """(markup, a function that gives a random text of it)."""
    parts = []
    for _ in range(rng.randint(1, 3)):
        kind = rng.random()
        if kind < 0.5 or depth > 2:
            words = [rng.choice("abc") for _ in range(rng.randint(1, 2))]
            parts.append((" ".join(words), lambda w=words: list(w)))
        elif kind < 0.8:
            markup, inner = _random_template(rng, depth + 1)
            parts.append((f"<<beginOptional>>{markup}<<endOptional>>", lambda f=inner: f() if rng.random() < 0.5 else []))
        else:
            n = rng.randint(0, 2)
            parts.append((f"<<var;{n}>>", lambda n=n: [rng.choice("abcz") for _ in range(rng.randint(0, n))]))
    return " ".join(p for p, _ in parts), lambda: [w for _, f in parts for w in f()]


def _brute(markup, words):
    """Whether the template stands in the words: sets of end places, by the structure of the markup."""
    tokens = re.findall(r"<<(?:beginOptional|endOptional|var;\d+)>>|\w+", markup)

    def run(at, starts):
        """End places after the tokens from ``at`` to the end of this region."""
        while at < len(tokens) and tokens[at] != "<<endOptional>>":
            if tokens[at] == "<<beginOptional>>":
                inner, at = run(at + 1, set(starts))
                starts = starts | inner
            elif tokens[at].startswith("<<var"):
                n = int(tokens[at][6:-2])
                starts = {s + k for s in starts for k in range(n + 1) if s + k <= len(words)}
            else:
                starts = {s + 1 for s in starts if s < len(words) and words[s] == tokens[at]}
            at += 1
        return starts, at

    return any(run(0, {i})[0] for i in range(len(words) + 1))


def test_automata_equal_brute_force():
    rng, accepted = random.Random(9), 0
    for _ in range(300):
        markup, text = _random_template(rng)
        markup = f"{markup} q r s"
        tail = "q r s".split()
        automaton = Automaton.compile("x", markup)
        for _ in range(6):
            own = [*text(), *tail]
            if rng.random() < 0.5 and own:
                own[rng.randrange(len(own))] = rng.choice("abcqz")
            words = [rng.choice("abcq") for _ in range(rng.randint(0, 4))] + own + [rng.choice("abs") for _ in range(2)]
            got = automaton.accepts(K.hash_words(" ".join(words), K.ALNUM))
            assert got == _brute(markup, words), (markup, words)
            accepted += got
    assert accepted > 500


@pytest.mark.parametrize("bad", ["a b c <<beginOptional>> d", "a b c <<endOptional>>", "a b c <<beginOptional>>d<<endOptional>><<endOptional>>", "a b c <<oops>> d"])
def test_unbalanced_marks_are_refused(bad):
    with pytest.raises(ValueError, match="template x"):
        Automaton.compile("x", bad)


def test_nested_optional_regions():
    a = Automaton.compile("x", "a b c <<beginOptional>>d <<beginOptional>>e<<endOptional>> f<<endOptional>> g")
    accepts = lambda t: a.accepts(K.hash_words(t, K.ALNUM))
    assert accepts("a b c g") and accepts("a b c d f g") and accepts("x a b c d e f g y") and not accepts("a b c e g") and not accepts("a b c d e g")


def test_many_anchors_in_a_very_long_text(spark):
    text = "permission to use copy modify " * 60_000 + "released under the MIT License"
    (row,) = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row["labels"] == "mit" and row["score"] == 1.0 and row["n_words"] == 300_005


def brute_languages(rows):
    """Word-first backoff on dictionaries: (best language, its log score minus the next) of each text."""
    import math

    find = re.compile("[a-z\x80-\U0010ffff]+")
    cut = lambda t: find.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    langs = sorted({x for i, t, x, _ in rows if x and t is not None and i is not None and zlib.crc32(str(i).encode()) % 5})
    counts = {o: {} for o in range(6)}
    for i, t, lang, _ in rows:
        if lang and t is not None and i is not None and zlib.crc32(str(i).encode()) % 5:
            for w in cut(t):
                for o in range(6):
                    for g in [w] if o == 0 else [w[j : j + o] for j in range(len(w) - o + 1)]:
                        own = counts[o].setdefault(g, dict.fromkeys(langs, 0))
                        own[lang] += 1
    totals = {o: {x: max(1, sum(g[x] for g in counts[o].values())) for x in langs} for o in counts}
    log = lambda o, g, x: math.log(counts[o][g][x] + 0.5) - math.log(totals[o][x] + 0.5 * (len(counts[o]) + 1))
    out = []
    for _, t, *_ in rows:
        score, known = dict.fromkeys(langs, 0.0), 0
        for w in cut(t):
            known += w in counts[0]
            for o in (0, 5, 4, 3, 2, 1):
                grams = [g for g in ([w] if o == 0 else [w[j : j + o] for j in range(len(w) - o + 1)]) if g in counts[o]]
                if grams:
                    for x in langs:
                        score[x] += sum(log(o, g, x) for g in grams) / len(grams)
                    break
        out.append((score, len(cut(t)), known))
    return langs, out


def test_languages_equal_brute_force(spark):
    import math

    rng = random.Random(12)
    rows = language_rows(120)
    rows += [(2000 + i, " ".join("".join(rng.choice("thenderléß") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 12))), None, "s") for i in range(60)]
    rows += [(3000, "the", "en", "s"), (3001, "rareonce seen", "fr", "s"), (3002, "rareonce", None, "s")]
    langs, want = brute_languages(rows)
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    for (i, *_), (score, n, known) in zip(rows, want, strict=True):
        best = max(langs, key=lambda x: score[x])
        r = got[i]
        assert (r["n_words"], r["known_words"]) == (n, known)
        chance = 1 / sum(math.exp((score[x] - score[best]) * min(n, 20) / n) for x in langs)
        assert r["lang_pred"] == best or score[best] - score[r["lang_pred"]] < 1e-3
        assert abs(r["score"] - chance) < 1e-3
    assert got[3002]["known_words"] == 1  # a word that was learned once is no unseen one


def test_rare_languages_are_learned(spark, monkeypatch):
    from textsieve.llm import language_id

    monkeypatch.setattr(language_id, "TRAIN_DOCS", 40)
    rows = [(i, "the water of the house and thing", "en", "s") for i in range(2000)] + [(5000 + i, "vesi ja talo on suuri", "fi", "s") for i in range(12)]
    got = {r["doc_id"]: r["lang_pred"] for r in identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == "fi" for i in range(5000, 5012)) and all(got[i] == "en" for i in range(100))


UNITS = {"miles", "hours", "kg"}


def brute_leaks(text, item):
    """(coverage, exact) of the best consistent alignment of an item in a text, by plain windows."""

    def forms(t):
        out, before = [], 0
        for m in re.finditer(r"[A-Za-z0-9]+(?:[.,](?<=\d.)(?=\d)[A-Za-z0-9]+)*", t):
            w, opens = m[0], not out or any(c in ".?!:;\n\r\"" for c in t[before : m.start()])
            number = re.fullmatch(r"[0-9.,]+", w) is not None
            name = w[0].isupper() and not opens and not number and len(w) > 1
            unit = not opens and w.lower() in UNITS and bool(out) and out[-1][1] == "#"
            out.append((w.lower(), "@" if name else "%" if unit else "#" if number else w.lower()))
            before = m.end()
        return out

    def hashes(f, at, size):
        own = f[at : at + size]
        raw, form = tuple(r for r, _ in own), tuple(x for _, x in own)
        slots = sum(x in "@%#" for x in form)
        found = set()
        if 2 * (size - slots) >= size:
            found.add(form)
        if slots:
            found.add(raw)
        if form[0] in ("@", "%") and 2 * (size - slots + 1) >= size and slots > 1:
            found.add((raw[0], *form[1:]))
        return found | ({form} if not slots else set())

    d, q = forms(text), forms(item)
    size = min(8, len(q))
    best = None
    light = [j for j in range(len(q) - size + 1) if any(any(x in "@%#" for x in h) or h == tuple(x for _, x in q[j : j + size]) for h in hashes(q, j, size)) and (2 * sum(x not in "@%#" for _, x in q[j : j + size]) >= size or q[j][1] in ("@", "%") and 2 * (sum(x not in "@%#" for _, x in q[j : j + size]) + 1) >= size)]
    for shift in range(-len(q), len(d)):
        hit = [j for j in range(len(q) - size + 1) if 0 <= j + shift <= len(d) - size and hashes(q, j, size) & hashes(d, j + shift, size)]
        if not hit:
            continue
        pairs = {(q[j + k][0], d[j + shift + k][0]) for j in hit for k in range(size) if q[j + k][1] in ("@", "%", "#")}
        if len({a for a, _ in pairs}) < len(pairs) or len({b for _, b in pairs}) < len(pairs):
            continue
        coverage = max(len(hit) / (len(q) - size + 1), len(set(hit) & set(light)) / len(light) if light else 0)
        if coverage >= 0.5 or len(hit) >= 6:
            best = max(best or (0, False), (coverage, all(a == b for a, b in pairs)))
    return best


def test_leaks_equal_brute_force(spark):
    rng = random.Random(21)
    plain = "when does the train stop near old town with all of its goods and people on board".split()
    value = {"#": lambda: str(rng.randint(2, 99)), "@": lambda: rng.choice(["Boston", "Denver", "Albany", "Tulsa", "Reno"]), "%": lambda: rng.choice(sorted(UNITS))}
    templates = []
    for _ in range(12):
        kinds = [rng.choice(["w", "w", "w", "#", "@"]) for _ in range(rng.randint(5, 16))]
        templates.append([rng.choice(plain) if k == "w" else k for k in kinds])
    fill = lambda t: " ".join(value[w]() if w in value else w for w in t)
    items = [(i, fill(t)) for i, t in enumerate(templates)]
    texts = []
    for _ in range(120):
        i, t = rng.choice(list(enumerate(templates)))
        own = items[i][1] if rng.random() < 0.4 else fill(t)
        if rng.random() < 0.3:
            own = own.replace(rng.choice(plain), rng.choice(plain))
        texts.append(f"{rng.choice(['so', 'as we know', 'Look.', ''])} {own} {rng.choice(['now', '.', 'and more'])}".strip())
    got = {k: (r["coverage"], r["exact"]) for k, r in leaks(spark, texts, items).items()}
    want = {(n, i): found for n, t in enumerate(texts) for i, q in items if (found := brute_leaks(t, q))}
    assert set(got) == set(want) and len(want) > 60
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want)


def test_short_items_are_sentences(spark):
    texts = ["Well. Who are you? I asked", "tell me who are you now", "who are you", "WHO ARE YOU", "Paris!"]
    got = leaks(spark, texts, [(1, "Who are you?"), (2, "Paris"), (3, "")])
    assert set(got) == {(0, 1), (2, 1), (3, 1), (4, 2)}
