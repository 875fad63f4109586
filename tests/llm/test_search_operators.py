"""Substring dedup, decontamination and SimHash against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import regex
from conftest_llm import prose, words

from quern.llm import decontaminate, kernel, simhash, substring

_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")


def folded(text):
    return _WORD.findall((text or "").lower())


# --- substring dedup ---------------------------------------------------------------------------------------------


def brute_units(text):
    for m in re.finditer(r"(?:[^.!?\n]|[.!?](?![ \t\n\f\r]))*(?:[.!?](?=[ \t\n\f\r])|\n|$)", text or ""):
        unit = m.group().strip(" \t\n\f\r")
        if unit:
            start = m.start() + len(m.group()) - len(m.group().lstrip(" \t\n\f\r"))
            yield start, start + len(unit), folded(unit)


def brute_repeats(rows, least=5, run=20):
    """(doc_id, start, stop, words, kept id, kept start) of the units of repeating passages; a text's key orders texts of one id."""
    texts = sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None})
    units = {x: [u for u in brute_units(x[1]) if len(u[2]) >= least] for x in texts}
    first = {}
    for x in texts:
        for start, _, w in units[x]:
            first.setdefault(tuple(w), []).append((x[0], start, x[1]))
    out = set()
    for x in texts:
        held = []
        for u in [*units[x], None]:
            origin = min(first[tuple(u[2])])[:2] if u else None
            if u and (origin != (x[0], u[0])):
                held.append((x[0], u[0], u[1], len(u[2]), *origin))
                continue
            if sum(h[3] for h in held) >= run:
                out |= set(held)
            held = []
    return out


def test_substring_matches_brute_force(frame, odd_rows):
    rng = random.Random(1)
    passage = prose(rng, 60)
    rows = odd_rows + [(400 + k, prose(rng, 20)[:-1] + " " + passage.replace("\n", " ") + " " + prose(rng, 20)) for k in range(4)]
    rows += [(410 + k, prose(rng, 30) + "\nAll rights reserved to their owners.\n" + prose(rng, 30)) for k in range(4)]
    rows += [(420, "😀 Ten words of 𐐀𐐁 and é are in this unit. 😀 " + passage)]
    got = {tuple(r) for r in substring.repeats(frame(rows)).collect()}
    assert got == brute_repeats(rows)
    assert {r[0] for r in got} >= {401, 402, 403, 420} and not {r[0] for r in got} & {410, 411, 412, 413}


def test_substring_clean_keeps_first_and_columns(frame, odd_rows):
    docs = frame(odd_rows)
    out = substring.clean(docs)
    assert out.schema == docs.schema
    texts = {r["doc_id"]: r["text"] for r in out.where("doc_id in (100, 101)").collect()}
    assert folded(texts[101]) == [] and len(folded(texts[100])) > 100
    assert out.count() == len(odd_rows)


def test_substring_clean_cuts_each_text_by_its_own_spans(frame):
    rng = random.Random(14)
    passage = "Alpha beta gamma delta epsilon zeta eta. Theta iota kappa lambda mu nu xi. Omicron pi rho sigma tau upsilon phi chi."
    rows = [(1, passage), (2, passage + " Unique words come last here."), (2, "Completely other text which never repeats anything at all, honest."), (2, prose(rng, 40) + " " + passage), (None, passage)]
    out = [(r["doc_id"], r["text"]) for r in substring.clean(frame(rows)).collect()]
    want = [(1, passage), (2, "   Unique words come last here."), (2, rows[2][1]), (2, rows[3][1][: -len(passage)] + "  "), (None, passage)]
    assert sorted(out, key=str) == sorted(want, key=str)


def test_substring_empty_table(frame):
    assert substring.repeats(frame([])).count() == 0


# --- decontamination ---------------------------------------------------------------------------------------------


def brute_leaks(rows, items, window=13):
    out = set()
    for doc_id, text in ((r[0], r[1]) for r in rows):
        w = folded(text)
        for item_id, item in items:
            b = folded(item)
            k = min(window, len(b))
            grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
            hits = [i for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in grams] if k else []
            if hits:
                out.add((doc_id, item_id, len(hits), hits[0]))
    return out


def test_decontamination_matches_brute_force(spark, frame, odd_rows):
    rng = random.Random(2)
    items = [(k, " ".join(words(rng, rng.randint(5, 40)))) for k in range(30)] + [(90, "two words"), (91, None), (92, ""), (93, "..."), (94, "ba"), (None, " ".join(words(rng, 20)))]
    rows = list(odd_rows)
    for k in range(25):
        item = items[k][1].split()
        a = rng.randint(0, max(0, len(item) - 16))
        part = item[a : a + rng.randint(10, 16)]
        rows.append((500 + k, prose(rng, 30) + " " + ", ".join(part).upper() + " " + prose(rng, 30)))
    rows.append((600, items[3][1] + "\n" + items[3][1]))
    rows.append((601, " ".join(items[29][1].split()[:12])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(rows, items)
    assert {tuple(r) for r in decontaminate.leaks(frame(rows), bench).collect()} == want
    assert {tuple(r) for r in decontaminate.leaks(frame(rows), bench, group=7).collect()} == want
    assert len(want) > 20


def test_other_characters_between_and_in_words(spark, frame):
    item = "one two three 𐐀𐐁 four five six"
    rows = [(1, "one two three 😀 𐐨𐐩 four 🎉five, six seven"), (2, "one two three x𐐨𐐩 four five six"), (3, "ONE TWO THREE 𐐀𐐩\u3000four — five six")]
    want = brute_leaks(rows, [(1, item)])
    assert {tuple(r) for r in decontaminate.leaks(frame(rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()} == want
    assert {w[0] for w in want} == {1, 3}


def test_no_match_across_two_texts(spark, frame):
    item = "alpha beta gamma delta epsilon zeta"
    rows = [(1, "alpha beta gamma"), (2, "delta epsilon zeta"), (3, item + "s"), (4, "x" + item)]
    assert decontaminate.leaks(frame(rows), spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 0


def test_decontamination_keep_and_empty(spark, frame, odd_rows):
    bench = spark.createDataFrame([(1, odd_rows[0][1])], "item_id long, text string")
    docs = frame(odd_rows)
    out = decontaminate.keep(docs, bench)
    assert out.columns == docs.columns
    assert out.count() == len(odd_rows) - 1 and out.where("doc_id = 0").count() == 0
    again = decontaminate.keep(docs, spark.createDataFrame([(k, odd_rows[0][1][k : k + 200]) for k in range(0, 20, 4)], "item_id long, text string"), group=2)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    # each row by its own text, whatever its id
    rows = [(1, odd_rows[0][1]), (1, "harmless"), (None, "so " + odd_rows[0][1]), (None, "harmless too")]
    assert sorted(r["text"] for r in decontaminate.keep(frame(rows), bench).collect()) == ["harmless", "harmless too"]
    clash = bench.selectExpr("item_id", "text", "item_id AS doc_id", "text AS lang", "1 AS hits")
    assert decontaminate.leaks(docs, clash).count() == decontaminate.leaks(docs, bench).count()
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(frame([]), bench).count() == 0


# --- SimHash -----------------------------------------------------------------------------------------------------


def mixed(h):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> shift) * factor % 2**64
    return h ^ h >> 31


def brute_signature(text):
    """(signature, number of features) by single votes; of the library only the hash of a word."""
    w = [int(kernel.words(kernel.code_points([x])[0])[0][0]) for x in folded(text)]
    features = {mixed((a * 0x9E3779B97F4A7C15 + b) % 2**64) for a, b in itertools.pairwise(w)} or set(w)
    votes = Counter()
    for f in {f >> 20 for f in features}:
        words = mixed((f + 0x51ED270B0F2A3C55) % 2**64), mixed((f * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) % 2**64)
        for bit in range(128):
            votes[bit] += 1 if words[bit // 64] >> bit % 64 & 1 else -1
    return sum(1 << bit for bit in range(128) if votes[bit] > 0), len(features)


def brute_groups(rows, radius=simhash.RADIUS):
    rows = [(r[0], r[1]) for r in rows if r[0] is not None]
    of = {t: brute_signature(t or "") for t in {r[1] for r in rows}}
    sig, n = [of[r[1]][0] for r in rows], [of[r[1]][1] for r in rows]
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2):
        if n[i] and n[j] and (sig[i] ^ sig[j]).bit_count() <= radius:
            x, y = sorted((root(a[0]), root(b[0])))
            parent[y] = x
    return {(d, root(d)) for d in parent if root(d) != d}


def near_copies(rng, rows, copies=3):
    out = []
    for k in range(25):
        w = rows[k][1].split(" ")
        for c in range(copies):
            x = list(w)
            for _ in range(max(1, len(w) // 40)):
                x[rng.randrange(len(x))] = words(rng, 1)[0]
            out.append((1000 + 10 * k + c, " ".join(x)))
    return out


def test_simhash_matches_brute_force(frame, odd_rows):
    rows = odd_rows + near_copies(random.Random(3), odd_rows)
    want = brute_groups(rows)
    for tiles, tile_rows in ((16, 200_000), (1, 200_000), (4, 20)):
        got = {tuple(r) for r in simhash.duplicates(frame(rows), tiles=tiles, tile_rows=tile_rows).collect()}
        assert got == want
    caught = {d for d, _ in want}
    planted = {d for d, _ in near_copies(random.Random(3), odd_rows)}
    assert len(caught & planted) >= 0.9 * len(planted)
    assert {101, 102, 103} <= caught and not caught & set(range(60))


def test_simhash_finds_copies_of_another_length(frame):
    # a copy that lost a quarter of its text: within the radius, however the lengths differ
    rng = random.Random(11)
    rows = []
    for k in range(40):
        w = words(rng, 400)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:300]))]
    sig, _ = simhash.signatures_of([r[1] for r in rows])
    within = {(2 * k + 1, 2 * k) for k in range(40) if int(np.bitwise_count(sig[2 * k] ^ sig[2 * k + 1]).sum()) <= simhash.RADIUS}
    assert len(within) > 20
    for tiles, tile_rows in ((16, 200_000), (4, 20)):
        assert {tuple(r) for r in simhash.duplicates(frame(rows), tiles=tiles, tile_rows=tile_rows).collect()} == within


def test_close_pairs_is_exact():
    rng = np.random.default_rng(12)
    sig = rng.integers(0, 2**63, (9000, 2), dtype=np.uint64)
    for k in range(0, 9000, 3):  # copies 20 to 32 bits away, in one half or over both
        sig[k + 1] = sig[k]
        for b in rng.choice(128 if k % 2 else 64, rng.integers(20, 33), replace=False):
            sig[k + 1, b // 64] ^= np.uint64(1 << int(b % 64))
    sig = sig[np.argsort(simhash.populations(sig), kind="stable")]
    want = set()
    for i in range(len(sig)):
        far = np.bitwise_count(sig[i] ^ sig[i + 1 :]).sum(axis=1)
        want |= {(i, i + 1 + int(j)) for j in np.flatnonzero(far <= simhash.RADIUS)}
    u, v = simhash.close_pairs(sig, sig, simhash.RADIUS, True)
    assert len(u) == len(want) > 500 and set(zip(u.tolist(), v.tolist(), strict=True)) == want
    u, v = simhash.close_pairs(sig[:5000], sig[5000:], simhash.RADIUS, False)
    assert set(zip(u.tolist(), (v + 5000).tolist(), strict=True)) == {p for p in want if p[0] < 5000 <= p[1]}


def test_tile_pairs_are_skipped_by_counts_alone(spark):
    # signatures of few and of many bits: what is far apart in its counts isn't compared, what is near is
    rng = np.random.default_rng(13)
    bits = np.concatenate([rng.random((600, 128)) < 0.2, rng.random((600, 128)) < 0.8])
    sig = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    sig = np.unique(sig, axis=0)
    counts = Counter(simhash.populations(sig).tolist())
    first, many, ends = simhash.tiling(dict(counts), 8, 10**6)
    pairs = [(x, y) for i, x in enumerate(ends) for y in ends[i:]]
    skipped = [p for p in pairs if max(p[0][0] - p[1][1], p[1][0] - p[0][1]) > simhash.RADIUS]
    assert len(skipped) >= 0.2 * len(pairs)
    assert all(first[p] + many[p] <= len(ends) and ends[first[p]][0] <= p <= ends[first[p]][1] for p in counts)
    points = spark.createDataFrame([(k, int(a.view(np.int64)), int(b.view(np.int64))) for k, (a, b) in enumerate(sig)], "node long, h0 long, h1 long")
    want = simhash.forest(*np.nonzero(np.triu(np.bitwise_count(sig[:, None] ^ sig[None]).sum(axis=2) <= 40, 1)), len(sig))
    got = dict(tuple(r) for r in simhash.components(simhash.edges(points, 40, 8, 100)).collect())
    assert [got.get(k, k) for k in range(len(sig))] == want.tolist()


def test_blocks_find_every_near_pair_and_compare_few(spark):
    # within the radius, two signatures are within the threshold of some block; of all pairs few are compared
    for n, radius in ((10, 0), (10, 3), (60_000, 26), (3_000_000, 26), (3_000_000, 40)):
        blocks = simhash.blocks_of(n, radius)
        assert sum(t + 1 for _, _, t in blocks) == radius + 1 and sum(b for _, b, _ in blocks) <= 128
        assert all(x[0] + x[1] <= y[0] for x, y in itertools.pairwise(blocks)) and blocks[-1][0] + blocks[-1][1] <= 128
    share = sum(sum(math.comb(b, e) for e in range(t + 1)) / 2**b for _, b, t in simhash.blocks_of(3_000_000, 26))
    assert share < 0.08
    rng = np.random.default_rng(31)
    sig = rng.integers(0, 2**63, (900, 2), dtype=np.uint64)
    for k in range(0, 900, 3):  # chains of copies, each 20 to 32 bits from the one before; some in one half
        for c in (1, 2):
            sig[k + c] = sig[k + c - 1]
            for b in rng.choice(128 if k % 2 else 64, rng.integers(20, 33), replace=False):
                sig[k + c, b // 64] ^= np.uint64(1 << int(b % 64))
    rows = [(k, int(a.view(np.int64)), int(b.view(np.int64))) for k, (a, b) in enumerate(np.unique(sig, axis=0))]
    points = spark.createDataFrame(rows, "node long, h0 long, h1 long")
    all_pairs = [tuple(r) for r in simhash.components(simhash.edges(points)).collect()]
    for file_rows in (10**6, 200):
        found = simhash.components(simhash.block_edges(points, len(rows), simhash.RADIUS, 3, file_rows))
        assert len(all_pairs) > 200 and sorted(tuple(r) for r in found.collect()) == sorted(all_pairs)


def test_simhash_by_blocks_matches_brute_force(frame, odd_rows):
    rows = odd_rows + near_copies(random.Random(3), odd_rows)
    got = {tuple(r) for r in simhash.duplicates(frame(rows), blocks_from=1).collect()}
    assert got == brute_groups(rows)
    assert simhash.duplicates(frame([]), blocks_from=1).count() == 0


def test_no_text_is_lost_where_rows_share_an_id(frame):
    rng = random.Random(15)
    a, b = prose(rng, 200), prose(rng, 200)
    rows = [(3, a), (5, a), (5, b), (9, b)]
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.keep(frame(rows)).collect())
    assert kept == [(3, a), (5, b)]


def test_signature_by_definition():
    text = "one two three two three four"
    sig, n = simhash.signatures_of([text, "", "word", "!"])
    for k, t in ((0, text), (2, "word")):
        assert int(sig[k, 0]) | int(sig[k, 1]) << 64 == brute_signature(t)[0]
    assert n.tolist() == [4, 0, 1, 0]  # pairs: one-two, two-three, three-two, three-four
    again, _ = simhash.signatures_of([text.upper().replace(" ", ", ")])
    assert np.array_equal(again[0], sig[0])


def test_simhash_keep(frame, odd_rows):
    docs = frame(odd_rows)
    kept = simhash.keep(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert {100, 200, 201, 203, 204} <= set(ids) and not {101, 102, 103, 206} & set(ids)
    assert ids.count(None) == 2
    assert simhash.duplicates(frame([])).count() == 0


def test_long_chains_are_one_group(spark):
    edges = [(k + 1, k) for k in range(200)] + [(900, 901), (902, 901)]
    got = dict(tuple(r) for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(1, 201)}, 901: 900, 902: 900}
