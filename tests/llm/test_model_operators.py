"""Perplexity, toxicity, language identification, line dedup, packing, token blocks and quotation linking."""

from __future__ import annotations

import math
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import prose, words
from pyspark.sql import functions as F

from quern.llm import kernel, langid, linededup, packing, perplexity, quotation, tokenbin, toxicity


# --- kernel ------------------------------------------------------------------------------------------------------


def test_words_are_found_and_hashed_alike_anywhere():
    texts = ["One, two; ÉTÉ été 漢字 x2", "", "two 𐐀𐐁", "…"]
    cps, bounds = kernel.code_points(texts)
    h, s, e = kernel.words(cps)
    found = ["".join(map(chr, cps[a:b])).lower() for a, b in zip(s, e)]
    assert found == ["one", "two", "été", "été", "漢字", "x2", "two", "𐐨𐐩"]
    assert h[2] == h[3] and h[1] == h[6] and len(set(h.tolist())) == 6
    assert bounds.tolist() == [0, len(texts[0]) + 1, len(texts[0]) + 2, len(texts[0]) + len(texts[2]) + 3, len(cps)]


def test_folding_of_all_planes():
    texts = ["a 😀 b", "one😀two", "𐐀𐐨", "İx", "🄰 ½ e\u0301"]
    cps, bounds = kernel.code_points(texts)
    h, s, e = kernel.words(cps)
    assert ["".join(map(chr, kernel.fold(cps[a:b]))) for a, b in zip(s, e)] == ["a", "b", "one", "two", "𐐨𐐨", "ix", "½", "e\u0301"]
    every = np.arange(0x110000, dtype=np.uint32)
    every = every[(every < 0xD800) | (every > 0xDFFF)]
    want = [ord(chr(c).lower()[0]) if unicodedata.category(chr(c))[0] in "LNM" else 0 for c in every.tolist()]
    assert kernel.fold(every).tolist() == want


# --- perplexity --------------------------------------------------------------------------------------------------


def brute_symbols(text):
    """The symbols of a text with its beginning and end: pairs for characters beyond the first 1917."""
    out, before = [(1,)] * (perplexity.ORDER - 1), None
    for c in text:
        if c == before and unicodedata.category(c)[0] not in "LNM":
            continue
        before, n = c, ord(c)
        out += [("c", n)] if n < 1917 else [("lead", n >> 10), ("trail", n & 1023)]
    return [*out, (2,)]


def brute_kneser_ney(texts):
    """p(gram) of interpolated modified Kneser-Ney over dictionaries."""
    order = perplexity.ORDER
    counts = Counter()
    for t in texts:
        s = brute_symbols(t)
        counts.update(tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s)))
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    lower = None
    for k in range(1, order + 1):
        t = tables[k]
        n = [sum(1 for c in t.values() if c == i) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = (1 - 2 * y * n[1] / n[0] if n[0] else 0.5, 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5)
        d = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]
        total, taken = Counter(), Counter()
        for g, c in t.items():
            total[g[:-1]] += c
            taken[g[:-1]] += d[min(c, 3) - 1]
        p = {}
        for g, c in t.items():
            q = 1 / (len(t) + 1) if k == 1 else lower[g[1:]]
            p[g] = (c - d[min(c, 3) - 1]) / total[g[:-1]] + taken[g[:-1]] / total[g[:-1]] * q
        lower = p
    return lower


def brute_scores(rows):
    """(nll, symbols) of each text by the model of all texts of its language."""
    out = [None] * len(rows)
    for lang in {r[2] or "und" for r in rows}:
        own = [i for i, r in enumerate(rows) if (r[2] or "und") == lang and r[1]]
        p = brute_kneser_ney([rows[i][1] for i in own])
        for i in own:
            s = brute_symbols(rows[i][1])
            out[i] = (-sum(math.log(p[tuple(s[k - 4 : k + 1])]) for k in range(4, len(s))), len(s) - 5)
    return out


@pytest.mark.parametrize("segment", [10**7, 300])
def test_perplexity_matches_brute_force(spark, frame, segment):
    rng = random.Random(4)
    shift = lambda t: "".join(chr(0x4E00 + ord(c) * 7) if c != " " and rng.random() < 0.5 else c for c in t)
    rows = [(k, prose(rng, rng.randint(5, 40)), "en" if k % 3 else None) for k in range(60)]
    rows += [(100 + k, shift(prose(rng, 20)) + "!!!😀😀 \x01\x02", "zh") for k in range(10)]
    docs = frame(rows)
    model = perplexity.cut(perplexity.kneser_ney(perplexity.cut(perplexity.ngram_counts(docs))))
    folder = perplexity.own_folder(spark, "test")
    files = perplexity.write_model(model, folder, segment)
    assert sum(f["n"] for f in files) == model.count() and all(f["n"] <= segment for f in files)
    got = {r["doc_id"]: r for r in perplexity.scores(docs.select("doc_id", "text", "lang"), folder, files).collect()}
    for (doc_id, _, lang), (nll, n) in zip(rows, brute_scores(rows)):
        assert got[doc_id]["nll"] == pytest.approx(nll, rel=1e-4)
        assert (got[doc_id]["n"], got[doc_id]["lang"]) == (n, lang or "und")


def test_no_two_characters_are_one_symbol():
    text = "漢字" * 3
    far = "".join(chr(ord(c) + 1024) for c in text)
    assert not np.array_equal(perplexity.grams([text])[0], perplexity.grams([far])[0])
    every = np.array([c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    sym, n = perplexity.symbols(every)
    first = np.cumsum(n) - n
    pairs = {(int(sym[i]), int(sym[i + 1]) if k == 2 else 0) for i, k in zip(first.tolist(), n.tolist())}
    assert len(pairs) == len(every) and sym.max() < 4096 and sym.min() > 2


def test_model_backs_off_for_unseen_text(spark, frame):
    rng = random.Random(4)
    docs = frame([(k, prose(rng, 60)) for k in range(30)])
    rows = perplexity.cut(perplexity.kneser_ney(perplexity.cut(perplexity.ngram_counts(docs))))
    folder = perplexity.own_folder(spark, "test")
    model = perplexity.open_model(folder, perplexity.write_model(rows, folder))["en"]
    rows = rows.toArrow()
    g, _ = perplexity.grams(["Zebra qqq ba"])
    lp = perplexity.log_probability(model, g)
    assert np.all(np.isfinite(lp)) and np.all(lp < 0)
    # what can follow one context, seen or not, has probabilities that add up to 1
    context = np.uint64(int(rows["g"].to_numpy()[rows["k"].to_numpy() == 5][0]) >> 12)
    symbols = np.unique(rows["g"].to_numpy()[rows["k"].to_numpy() == 1]).astype(np.uint64)
    total = np.exp(perplexity.log_probability(model, (context << np.uint64(12)) | symbols).astype(float)).sum()
    assert total == pytest.approx(1 - math.exp(perplexity.log_probability(model, np.array([(int(context) << 12) | 4000], np.uint64))[0]), abs=1e-3)


def test_rows_are_kept_by_their_own_text(frame):
    rng = random.Random(16)
    rows = [(k, prose(rng, 150)) for k in range(100)] + [(5, "#$%& " * 300), (None, "|#" * 400), (None, prose(rng, 150)), (7, "")]
    kept = [(r["doc_id"], r["text"]) for r in perplexity.keep(frame(rows)).collect()]
    assert (5, rows[5][1]) in kept and (None, rows[102][1]) in kept
    assert not {(5, rows[100][1]), (None, rows[101][1]), (7, "")} & set(kept)


def test_perplexity_rejects_noise_and_keeps_prose(frame, odd_rows):
    rng = random.Random(6)
    rows = odd_rows + [(1000 + k, prose(rng, 150)) for k in range(150)]
    rows += [(2000, "#$%& " * 300), (2001, "BA TO RI " * 200), (2002, "|".join(words(rng, 300)))]
    docs = frame(rows)
    kept = perplexity.keep(docs)
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns
    assert not {200, 201, 2000, 2001, 2002} & set(ids)
    assert sum(k in ids for k in range(1000, 1150)) >= 148
    assert perplexity.judged(frame([])).count() == 0


# --- toxicity ----------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark, frame):
    rng = random.Random(7)
    bad = ["grubworm", "slimeball", "dirtbag"]
    rows, labels = [], []
    for k in range(900):
        w, toxic = words(rng, rng.randint(20, 120)), k % 3 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "s", "ish"]))
        rows.append((k, " ".join(w), "en" if k % 2 else "de"))
        labels.append((k, int(toxic)))
    docs = frame(rows + [(1000, None), (1001, ""), (1002, "!"), (None, "a grubworm here", None), (1003, "grubworm " * 50_000)])
    known = spark.createDataFrame(labels[:600] + [(None, 1), (5, None), (77, 0)], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.fit(docs, known)).collect()
    flagged = {r["doc_id"] for r in got if r["toxicity"] >= r["threshold"] and r["toxicity"] > 0}
    held = [(k, t) for k, t in labels if k >= 600]
    assert np.mean([(k in flagged) == bool(t) for k, t in held]) > 0.97
    assert {1003, None} <= flagged and not {1000, 1001, 1002} & flagged and len(got) == docs.count()
    none = toxicity.fit(docs, known.where("toxic = 0"))
    assert toxicity.scored(docs, none).where("toxicity > 0").count() == 0


def test_toxicity_rare_languages_get_thresholds_of_their_own(spark, frame):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(1500):  # of the toxic labels 1 in 25 is of a document in "sw"
        w, lang, toxic = words(rng, rng.randint(20, 60)), "sw" if k % 25 == 0 else "en", k % 2 == 0 or k % 25 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["grubworm", "slimeball"]))
        rows.append((k, " ".join(w), lang))
        labels.append((k, int(toxic)))
    labels += [(10_000 + k, 1) for k in range(3000)]  # of no document
    rows += [(5000 + k, " ".join(words(rng, 30)), "sw") for k in range(30)]
    labels += [(5000 + k, 0) for k in range(30)]
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(frame(rows), known, train_rows=200)
    assert set(model.thresholds) == {"en", "sw"} and model.network is not None


def test_threshold_of_bins_equals_that_of_scores():
    rng = np.random.default_rng(3)
    scores, toxic = np.round(rng.random(400), 2), rng.random(400) < 0.4
    best = max((2 * np.sum(toxic & (scores >= x)) / (np.sum(toxic) + np.sum(scores >= x)), x) for x in np.unique(scores))
    got = toxicity.threshold((scores * 100).round().astype(int), scores, scores, toxic.astype(int), np.ones(400))
    assert 2 * np.sum(toxic & (scores >= got)) / (np.sum(toxic) + np.sum(scores >= got)) == pytest.approx(best[0])


def test_network_scores_equal_definition():
    rng = np.random.default_rng(1)
    net = toxicity.Network(
        np.concatenate([rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)), np.zeros((1, toxicity.DIM))]).astype(np.float32),
        [rng.normal(size=(w * toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
        [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS],
        rng.normal(size=3 * toxicity.FILTERS).astype(np.float32) * 0.05,
        0.1,
    )
    texts = ["one two three four five", "one", "", "two words"]
    got = net.scores(texts)
    for t, score in zip(texts, got):
        seq, start, end = toxicity.sequences([t])
        n = end[0] - start[0]
        x = toxicity.vectors(net.embedding, seq)
        f = [np.maximum((np.concatenate([x[o : o + n] for o in range(w)], axis=1) @ p + b).max(axis=0), 0) for w, p, b in zip(toxicity.WIDTHS, net.filters, net.bias)] if n else []
        want = 1 / (1 + math.exp(-(float(np.concatenate(f) @ net.out) + net.offset))) if n else 0
        assert score == pytest.approx(want, rel=1e-3)


# --- language identification -------------------------------------------------------------------------------------


def test_bloom_returns_every_language_and_corrects_false_positives():
    rng = np.random.default_rng(2)
    sets = {f"l{k:02d}": rng.integers(0, 2**64, 500, dtype=np.uint64) for k in range(70)}
    sets["l01"] = np.concatenate([sets["l01"], sets["l00"][:100]])
    bloom = langid.SlicedBloom(sets, slot_bits=4)
    for name, grams in sets.items():
        word, bit = bloom.place[name]
        assert np.all(bloom.languages(grams)[word] & bit)
    other = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    assert np.all(bloom.shares(other, np.array([0, 20_000]))[0] < 0.03)
    share = bloom.shares(np.concatenate([sets["l00"], other[:500]]), np.array([0, 1000]))[0]
    assert share[0] == pytest.approx(0.5, abs=0.05) and share[1] == pytest.approx(0.1, abs=0.05)


def test_language_held_out_accuracy_and_odd_rows(frame, odd_rows):
    rng = random.Random(8)
    tongues = {"xa": ["ba", "to", "ri"], "xb": ["mek", "sul", "an"], "xc": ["vo", "pel", "ku"]}
    make = lambda lang, n: " ".join("".join(rng.choices(tongues[lang], k=rng.randint(1, 4))) for _ in range(n))
    train = [(k, make(lang, 80), lang) for k, lang in enumerate(list(tongues) * 40)]
    held = [(1000 + k, make(lang, 12), lang) for k, lang in enumerate(list(tongues) * 40)]
    bloom = langid.filters(frame(train))
    got = langid.identify(frame(held), bloom).collect()
    assert len(got) == len(held) and np.mean([r["predicted"] == r["lang"] for r in got]) > 0.95
    odd = {r["doc_id"]: r for r in langid.identify(frame(odd_rows), bloom).collect()}
    assert all(odd[k]["predicted"] == "und" and odd[k]["confidence"] == 0 for k in (200, 201, 202, 203))
    assert langid.identify(frame([]), bloom).count() == 0
    nothing = langid.filters(frame([(1, "text", None)]))
    assert [r["predicted"] for r in langid.identify(frame([(1, "some text")]), nothing).collect()] == ["und"]


# --- line dedup --------------------------------------------------------------------------------------------------


def brute_line_dedup(rows, depth=3, similarity=0.75, min_docs=10):
    """Texts after dropping recurring templates, by the module's words and hashes but plain dictionaries."""
    parsed = []
    for doc_id, text in ((r[0], r[1]) for r in rows):
        x = linededup.lines_of([text or ""], depth)
        toks = [tuple(x["token"][f : f + n].tolist()) for f, n in zip(x["first"], x["n"])]
        parsed.append((doc_id, text, list(zip(toks, x["leaf"].tolist(), x["line"].view(np.int64).tolist()))))
    named = [(d, x) for d, t, x in parsed if d is not None and t is not None]
    freq, leaf_n, leaf_lines = Counter(), Counter(), defaultdict(dict)
    for _, lines in named:
        for toks, leaf, line in lines:
            if toks:
                leaf_n[leaf] += 1
                freq[line] += 1
                leaf_lines[leaf][line] = toks
    template = {}
    for leaf, lines in leaf_lines.items():
        if leaf_n[leaf] < min_docs:
            continue
        made = []
        for line in sorted(lines, key=lambda h: (-freq[h], h)):
            toks = lines[line]
            for t in made:
                if sum(a == b for a, b in zip(t[1], toks)) >= similarity * len(toks) - 1e-9:
                    t[1] = [a if a == b else None for a, b in zip(t[1], toks)]
                    template[line] = t[0]
                    break
            else:
                made.append([line, list(toks)])
                template[line] = line
    held = defaultdict(lambda: defaultdict(int))
    total = Counter()
    for d, lines in named:
        total[d] = max(total[d], sum(len(t) for t, _, _ in lines))
        for toks, _, line in lines:
            if toks and line in template:
                held[d][template[line]] += len(toks)
    often = Counter(t for d in held for t in held[d])
    copies = {d for d in held if 2 * sum(n for t, n in held[d].items() if often[t] >= min_docs) >= total[d] and any(often[t] >= min_docs for t in held[d])}
    # copies: those with the same set of lines, a template standing for its lines, count once, as the least of them
    sets = defaultdict(set)
    for d, lines in named:
        sets[d] |= {template.get(line, line) for toks, _, line in lines if toks}
    least = {}
    for d in copies:
        key = frozenset(sets[d])
        least[key] = min(d, least.get(key, d))
    further = copies - set(least.values())
    recur = Counter(t for d in held if d not in further for t in held[d])
    gone = {line for line, t in template.items() if recur[t] >= min_docs}
    return [(d, None if t is None else "\n".join(s for s, (toks, _, line) in zip(t.split("\n"), x) if not toks or line not in gone)) for d, t, x in parsed]


def test_line_dedup_matches_brute_force(frame, odd_rows):
    rng = random.Random(9)
    rows = list(odd_rows)
    page = prose(rng, 150)
    for k in range(30):
        rows.append((700 + k, f"Page {k} of {rng.randint(2, 99)} seen by visitors today\n" + prose(rng, 60) + "\nAll rights reserved to " + words(rng, 1)[0] + " and partners of this site"))
    rows += [(800 + k, page) for k in range(15)]
    rows += [(900 + k, "Page 4 of 7 seen by visitors today\n" + page) for k in range(3)]
    rows += [(950, "\n".join(f"Item {k} costs {k} coins each" for k in range(40)))]
    docs = frame(rows)
    out = linededup.clean(docs)
    assert out.schema == docs.schema
    got = sorted(((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()), key=str)
    assert got == sorted(brute_line_dedup(rows), key=str)
    texts = dict(got)
    assert texts[800] == page and texts[900] == page and "Page" not in texts[705] and "rights" not in texts[705]
    assert texts[950] == rows[-1][1]  # a list within one document doesn't recur across documents
    again = linededup.drop_lines(docs, linededup.recurring(docs.select("doc_id", "text")), per_file=5)
    assert sorted(((r["doc_id"], r["text"]) for r in again.select("doc_id", "text").collect()), key=str) == got


def test_templates_by_parts_are_those_of_one_by_one(monkeypatch):
    rng = np.random.default_rng(4)
    for width in (1, 2, 4, 7, 20, 33):
        base = rng.integers(1, 4, (12, width))
        tokens = base[rng.integers(0, 12, 400)]
        tokens = np.where(rng.random(tokens.shape) < 0.15, rng.integers(1, 9, tokens.shape), tokens).astype(np.int64)
        tokens[rng.random(tokens.shape) < 0.05] = np.int64(linededup._VARIABLE)
        by_parts = linededup.drain(tokens, 0.75)
        monkeypatch.setattr(linededup, "FEW_LINES", 10**9)
        assert np.array_equal(linededup.drain(tokens, 0.75), by_parts)
        monkeypatch.undo()


def test_large_leaves_are_divided(frame):
    # two templates that share their first words, on pages of their own
    rng = random.Random(22)
    rows = [(k, f"In the same {'northern' if k % 2 else 'southern'} harbour of {words(rng, 1)[0]} again\n{prose(rng, 60)}") for k in range(80)]
    want = [(r["doc_id"], r["text"]) for r in linededup.clean(frame(rows)).collect()]
    got = [(r["doc_id"], r["text"]) for r in linededup.clean(frame(rows), leaf_lines=10).collect()]
    assert sorted(got) == sorted(want) and not any("harbour" in t for _, t in got)


def test_templates_dont_depend_on_the_size_of_their_leaf(frame):
    # one template over pages with either of two words; a leaf divided by that word would part it into two that don't recur
    rng = random.Random(23)
    rows = [(k, f"In the same {'northern' if k % 2 else 'southern'} harbour of our town again\n{prose(rng, 60)}") for k in range(10)]
    rows = [(k, text.replace("town", words(random.Random(k), 1)[0])) for k, text in rows]
    rows += [(100 + k, f"In the same {'northern' if k % 2 else 'southern'} {' '.join(words(rng, 5))}\n{prose(rng, 60)}") for k in range(60)]
    want = sorted(brute_line_dedup(rows))
    assert not any("harbour" in t for _, t in want) and sum("In the same" in t for _, t in want) >= 50
    for few in (None, 10, 10**6):
        assert sorted((r["doc_id"], r["text"]) for r in linededup.clean(frame(rows), leaf_lines=few).collect()) == want


def test_line_dedup_of_pages_that_are_mostly_boilerplate(frame):
    rng = random.Random(21)
    line = lambda n: " ".join(words(rng, n))
    shared, other, page = line(60), line(55), "\n".join(line(20) for _ in range(8))
    rows = [(k, f"{line(12)}\n{shared}") for k in range(20)]  # own words: 1 in 6
    rows += [(100 + k, f"{line(15 if k < 3 else 200)}\n{other}") for k in range(12)]  # 3 of 12 are short
    rows += [(200 + k, page) for k in range(15)]  # copies of one page
    out = {r["doc_id"]: r["text"] for r in linededup.clean(frame(rows)).collect()}
    assert all(out[d] == t.split("\n")[0] for d, t in ((r[0], r[1]) for r in rows) if d < 200)
    assert all(out[200 + k] == page for k in range(15))


def test_line_dedup_empty_table(frame):
    assert linededup.clean(frame([])).count() == 0


# --- packing -----------------------------------------------------------------------------------------------------


def test_rows_without_ids_and_repeated_rows_spread_over_shards(spark, frame):
    rows = [(None, "ten words " * 5)] * 6000 + [(1, "ten words " * 5)] * 6000
    bins = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), shard_items=1000, islands=1, population=2, epochs=1, children=1).collect()
    per_shard = Counter()
    for b in bins:
        per_shard[b["bin_id"] >> 32] += len(b["sizes"])
    assert len(per_shard) == 12 and max(per_shard.values()) < 1500 and sum(per_shard.values()) == 12_000


def check_bins(bins, rows, capacity):
    n = Counter()
    for r in rows:
        n[r[0]] += len((r[1] or "").split())
    placed = Counter()
    for b in bins:
        assert b["filled"] == sum(b["sizes"]) <= capacity
        assert len(b["doc_ids"]) == len(b["pieces"]) == len(b["sizes"]) > 0
        for d, size in zip(b["doc_ids"], b["sizes"]):
            placed[d] += size
    assert placed == Counter({d: k for d, k in n.items() if k})
    assert len({b["bin_id"] for b in bins}) == len(bins)


def test_packing_holds_everything_once(frame, odd_rows):
    docs = frame(odd_rows)
    for options in ({}, {"shard_items": 20, "epochs": 2}):
        bins = packing.pack(docs, capacity=256, **options).collect()
        check_bins(bins, odd_rows, 256)
        assert sorted(map(str, bins)) == sorted(map(str, packing.pack(docs, capacity=256, **options).collect()))
    assert packing.pack(frame([])).count() == 0
    assert packing.pack(frame([(1, None), (2, "")])).count() == 0


def test_genetic_packing_is_no_worse_than_best_fit_decreasing():
    rng = np.random.default_rng(3)
    sizes = rng.integers(200, 700, 400)
    members = packing.first_generation(sizes, 1000, 4, rng)
    greedy = members[0]
    for _ in range(10):
        members = packing.evolve(members, sizes, 1000, 4, rng)
    best = members[0]
    assert best.fitness(1000) >= greedy.fitness(1000) and len(best.fill) <= len(greedy.fill)
    assert np.array_equal(np.bincount(best.bin_of, weights=sizes), best.fill) and best.fill.max() <= 1000
    # against the optimum where it is known: each bin of 10 was cut into 3 pieces
    cuts = np.sort(rng.integers(100, 900, (10, 2)), axis=1)
    exact = np.concatenate([cuts[:, 0], cuts[:, 1] - cuts[:, 0], 1000 - cuts[:, 1]])
    exact = exact[exact > 0]
    members = packing.first_generation(exact, 1000, 4, rng)
    for _ in range(60):
        members = packing.evolve(members, exact, 1000, 4, rng)
    assert len(members[0].fill) <= 11


def test_crossover_injects_whole_bins():
    rng = np.random.default_rng(4)
    sizes = rng.integers(100, 600, 60)
    a, b = packing.first_generation(sizes, 1000, 2, rng)
    child = packing.crossover(a, b, sizes, 1000, rng)
    whole = lambda p: {frozenset(np.flatnonzero(p.bin_of == k).tolist()) for k in range(len(p.fill))}
    assert whole(child) & whole(a) and child.fill.max() <= 1000 and child.fill.sum() == sizes.sum()


# --- token blocks ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_token_blocks_round_trip(spark, frame, odd_rows, mode):
    rows = odd_rows + [(301, " ".join(words(random.Random(1), 3000)))]
    blocks = tokenbin.write_blocks(frame(rows), mode=mode, block_ids=1000).cache()
    raw = blocks.collect()
    assert all(r["n_ids"] <= 1000 and len(r["planes"]) == (16 if mode == "bit" else 2) for r in raw)
    with open(tokenbin.VOCABULARY, "rb") as f:
        enc = tokenbin.encoder(f.read())
    want = sorted((str(r[0]), enc.encode_ordinary(r[1] or "")) for r in rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in tokenbin.read_documents(blocks).collect()) == want
    one = blocks.where(F.array_contains("doc_ids", 301))
    assert 2 < one.count() < len(raw)
    assert tokenbin.write_blocks(frame([])).count() == 0


def test_planes_round_trip():
    rng = np.random.default_rng(5)
    for width, n in ((2, 1), (2, 65_536), (4, 1001)):
        ids = rng.integers(0, 2 ** (8 * width), n)
        for mode in ("bit", "byte"):
            assert np.array_equal(tokenbin.from_planes(tokenbin.to_planes(ids, width, mode), n, width), ids)


# --- quotation linking -------------------------------------------------------------------------------------------


def test_quotes_are_linked_and_removed(spark):
    first, second, third = "The first message has words.\nAnd a second line of them.", "A second message, unlike it.", "The third one comes after that."
    mails = [
        (1, 0, "user", first),
        (1, 1, "assistant", second),
        (1, 2, "user", third),
        (1, 3, "assistant", f"On Monday someone wrote:\n> {first.splitlines()[0]}\n> {first.splitlines()[1]}\n\nI answer the first."),
        (1, 4, "user", "> A second  MESSAGE, unlike it\nI answer the second."),
        (1, 5, "assistant", "> > The first message has words.\n>\n> I answer the first.\n\nTo the fourth."),
        (1, 6, "user", "> nobody said this here\nNo origin."),
        (1, 7, "user", None),
        (1, 7, "user", None),
        (2, 1, "user", ""),
        (2, 0, "user", "5 > 3 and no quote"),
        (None, 0, "user", "> lost\nkept"),
        (3, None, "user", "text"),
    ]
    table = spark.createDataFrame([(*m, 1) for m in mails], "conv_id long, turn long, role string, text string, parent long")
    rows = quotation.threads(table).collect()
    assert len(rows) == len(mails)
    at = {(r["conv_id"], r["turn"]): r for r in rows}
    assert [at[1, k]["parent_turn"] for k in range(8)] == [None, 0, 1, 0, 1, 3, 5, 6]
    # depth first, replies by turn: 0 (1 (2, 4), 3 (5 (6 (7))))
    assert [at[1, k]["position"] for k in range(8)] == [0, 1, 2, 4, 3, 5, 6, 7]
    assert [at[1, k]["depth"] for k in range(8)] == [0, 1, 2, 1, 2, 2, 3, 4]
    assert [at[1, k]["text"] for k in range(3, 8)] == ["I answer the first.", "I answer the second.", "To the fourth.", "No origin.", None]
    assert at[2, 0]["text"] == "5 > 3 and no quote" and at[2, 1]["parent_turn"] == 0
    assert at[None, 0]["text"] == "kept" and at[None, 0]["position"] is None and at[3, None]["parent_turn"] is None
    assert quotation.threads(table.limit(0)).count() == 0


def test_unquoted_conversations_keep_their_order(spark):
    rng = random.Random(10)
    mails = [(c, t, "user", prose(rng, 20)) for c in range(5) for t in range(rng.randint(1, 30))]
    rng.shuffle(mails)
    rows = quotation.threads(spark.createDataFrame(mails, "conv_id long, turn long, role string, text string")).collect()
    assert all(r["position"] == r["turn"] == r["depth"] for r in rows)
    assert {(r["conv_id"], r["turn"], r["text"]) for r in rows} == {(c, t, x) for c, t, _, x in mails}
