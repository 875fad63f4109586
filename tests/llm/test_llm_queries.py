"""The registered queries and the pipeline over small tables with odd rows, against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import regex
from conftest_llm import SCHEMA, prose, row, words
from test_model_operators import brute_line_dedup, brute_scores, check_bins
from test_search_operators import brute_groups, brute_leaks, brute_repeats, folded

from quern.llm import langid, perplexity, queries, quotation, simhash, tokenbin

BAD = ["grubworm", "slimeball", "dirtbag"]


def document_rows():
    rng = random.Random(31)
    rows = [(k, prose(rng, rng.randint(40, 160)), "en" if k % 4 else "de") for k in range(220)]
    rows = [(d, t.replace(" ", f" {rng.choice(BAD)} ", 2) if d % 2 == 0 else t, lang) for d, t, lang in rows]
    passage, page = prose(rng, 70), prose(rng, 120)
    rows += [(300 + k, prose(rng, 60) + "\n" + passage.replace("\n", " ") + "\n" + prose(rng, 60)) for k in range(12)]
    rows += [(320 + k, page) for k in range(6)] + [(330, page.upper()), (331, page + " One word more.")]
    rows += [(340 + k, f"Page {k} of 99 as seen by all visitors today\n" + prose(rng, 80)) for k in range(14)]
    rows += [(360 + k, prose(rng, 30) + " " + item + " " + prose(rng, 30)) for k, item in enumerate(items()[:6])]
    rows += [(380, "#$%& " * 300), (381, "BA TO RI " * 200), (382, None), (383, ""), (384, " \n\t"), (385, "!!! ???"), (386, "one")]
    rows += [(None, page), (None, None), (387, page, None), (388, "😀 " + prose(rng, 60)), (389, " ".join(words(rng, 6000)))]
    return rows


def items():
    rng = random.Random(32)
    return [" ".join(words(rng, n)) for n in (20, 30, 14, 25, 18, 40, 5, 12)]


def messages():
    rng = random.Random(33)
    out = []
    for c in range(12):
        said = []
        for t in range(rng.randint(1, 14)):
            text = prose(rng, rng.randint(2, 25))
            if said and rng.random() < 0.6:
                quoted = rng.choice(said).split("\n")
                text = "On Monday someone wrote:\n" + "\n".join("> " + x for x in quoted[: rng.randint(1, len(quoted))]) + "\n\n" + text
            said.append(text)
            out.append((c, t, rng.choice(["user", "assistant"]), text))
    said = ["Thank you very much indeed."] * 30  # a line that a whole conversation repeats
    out += [(50, t, "user", (f"> {x}\n" if t % 3 == 2 else "") + x) for t, x in enumerate(said)]
    return out + [(60, 0, "user", None), (60, 1, "user", ""), (None, 3, "user", "> lost\nkept"), (61, None, "user", "text")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables, and its documents as (doc_id, text, lang)."""
    at = tmp_path_factory.mktemp("tables")
    rows = [(*r, "en")[:3] if len(r) < 3 else r for r in document_rows()]
    write = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"{at}/{name}.parquet")
    write([row(*r) for r in rows], SCHEMA, "documents")
    # columns besides those that are read, with names that clash
    write([(k, t, k, "en", 1) for k, t in enumerate(items())] + [(90, None, 1, "en", 1), (91, "", 1, "en", 1)], "item_id long, text string, doc_id long, lang string, hits long", "benchmark")
    labels = [(r[0], int(any(b in (r[1] or "") for b in BAD)), 1, "x") for r in rows if r[0] is not None and r[0] < 220]
    write([x for x in labels if x[0] % 3] + [(None, 1, 0, "x"), (7, None, 0, "x")], "doc_id long, toxic int, quality int, text string", "labels")
    write([(*m, 1) for m in messages()], "conv_id long, turn long, role string, text string, parent long", "conversations")
    return str(at), rows


@pytest.fixture(scope="module")
def empty(spark, tables, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for name in ("documents", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def run(spark, tables, name):
    return [r.asDict() for r in queries.queries()[name](spark, tables[0]).collect()]


def brute_judged(rows, low=perplexity.LOW, high=perplexity.HIGH, prior=perplexity.PRIOR_CHARS):
    """(score, lower, upper, kept) of each row."""
    scores, lang = brute_scores(rows), [r[2] or "und" for r in rows]
    middle = lambda x: sorted(x)[math.ceil(len(x) / 2) - 1]
    out = [None] * len(rows)
    for name in set(lang):
        own = [i for i in range(len(rows)) if lang[i] == name and scores[i] is not None]
        if not own:
            continue
        mu = sum(scores[i][0] for i in own) / sum(scores[i][1] + 1 for i in own)
        x = {i: (scores[i][0] + prior * mu) / (scores[i][1] + 1 + prior) for i in own}
        med = middle(list(x.values()))
        mad = middle([abs(v - med) for v in x.values()])
        for i in own:
            out[i] = (x[i], med - low * mad, med + high * mad, len(own) < perplexity.LEAST_DOCS or med - low * mad <= x[i] <= med + high * mad)
    return out


def test_toxicity_held_out(spark, tables):
    found = {r["doc_id"] for r in run(spark, tables, "op1_cnn_toxicity")}
    held = [r for r in tables[1] if r[0] is not None and r[0] < 220 and r[0] % 3 == 0]
    assert sum((r[0] in found) == any(b in r[1] for b in BAD) for r in held) >= 0.95 * len(held)
    assert not found & {382, 383, 384, 385}


def test_perplexity(spark, tables):
    got = {r["doc_id"]: r for r in run(spark, tables, "op2_ngram_perplexity") if r["doc_id"] is not None}
    want = {r[0]: x for r, x in zip(tables[1], brute_judged(tables[1])) if x and x[3] and r[0] is not None}
    assert set(got) == set(want) and {380, 381} & set(got) == set()
    for d, (score, low, high, _) in want.items():
        assert [got[d][c] for c in ("perplexity", "lower", "upper")] == pytest.approx([math.exp(v) for v in (score, low, high)], rel=1e-3)


def test_languages(spark, tables):
    def grams(text):
        text = regex.sub(r"[^\p{L}\p{M}\p{N}]+|[0-9]+", " ", (text or "").lower())
        text = text if text[-1:].isspace() else text + " "  # the gap after the last word
        return [g for g in (text.lstrip()[i : i + 4] for i in range(len(text.lstrip()) - 3))]

    counts = defaultdict(Counter)
    for _, text, lang in tables[1]:
        if lang and text:
            counts[lang].update(grams(text))
    profiles = {lang: {g for g, n in c.items() if n >= langid.SHARE * sum(c.values())} for lang, c in counts.items()}
    got = sorted(run(spark, tables, "op3_bitmask_langid"), key=str)
    assert len(got) == len(tables[1])
    for r, (d, text, lang) in zip(sorted(got, key=lambda r: str((r["doc_id"], r["lang"]))), sorted(tables[1], key=lambda r: str((r[0], r[2]))), strict=True):
        own = grams(text)
        share = sorted(((sum(g in p for g in own) / len(own) if own else 0, name) for name, p in profiles.items()), reverse=True)
        if d is not None and len(own) > 100 and share[0][0] - share[1][0] > 0.02:
            assert r["predicted"] == share[0][1] and r["confidence"] == pytest.approx(share[0][0], abs=0.03)
        if not own:
            assert (r["predicted"], r["confidence"]) == ("und", 0)


def test_packing(spark, tables):
    bins = run(spark, tables, "op4_genetic_packing")
    check_bins(bins, tables[1], 2048)
    total = sum(b["filled"] for b in bins)
    assert len(bins) <= 1.1 * total / 2048 + 1


def test_line_dedup(spark, tables):
    got = sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in run(spark, tables, "op5_template_line_dedup")), key=str)
    lines = lambda t: len(t.split("\n")) if t else 0
    want = sorted(((d, t, lines(old) - lines(t) if t else sum(bool(folded(x)) for x in (old or "").split("\n"))) for (d, t), (_, old, _) in zip(brute_line_dedup(tables[1]), tables[1])), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g for g in got if g[1]] == [w for w in want if w[1]]


def test_token_blocks(spark, tables):
    blocks = queries.queries()["op6_bitplane_tokens"](spark, tables[0])
    with open(tokenbin.VOCABULARY, "rb") as f:
        enc = tokenbin.encoder(f.read())
    assert sorted((str(r["doc_id"]), r["ids"]) for r in tokenbin.read_documents(blocks).collect()) == sorted((str(r[0]), enc.encode_ordinary(r[1] or "")) for r in tables[1])


def test_substrings_leaks_and_groups(spark, tables):
    assert {tuple(r.values()) for r in run(spark, tables, "op7_line_hash_dedup")} == brute_repeats(tables[1])
    bench = [(k, t) for k, t in enumerate(items())]
    assert {tuple(r.values()) for r in run(spark, tables, "op8_wu_manber_leaks")} == brute_leaks(tables[1], bench)
    assert {tuple(r.values()) for r in run(spark, tables, "op9_simhash_groups")} == brute_groups(tables[1])


def brute_threads(rows, least=quotation.MIN_WORDS):
    """parent, position and depth of each message by comparing all passages of a conversation with all others."""
    out = {}
    for conv in {r[0] for r in rows} - {None}:
        own = sorted({r[1]: r for r in rows if r[0] == conv and r[1] is not None}.values(), key=lambda r: r[1])
        said = [[(tuple(folded(p))) for p in quotation.passages_of(r[3] or "")[0]] for r in own]
        parent = []
        for i, r in enumerate(own):
            best = None
            for level, text in quotation.passages_of(r[3] or "")[1]:
                w = tuple(folded(text))
                for j in range(i):
                    if len(w) >= least and w in said[j]:
                        best = max(best or (-99,), (-level, len(w), j))
            parent.append(best[2] if best else i - 1)
        position, depth = [], {}

        def walk(i, d):
            position.append(i)
            depth[i] = d
            for j, p in enumerate(parent):
                if p == i and j > i:
                    walk(j, d + 1)

        for i, p in enumerate(parent):
            if p < 0:
                walk(i, 0)
        for i, r in enumerate(own):
            out[conv, r[1]] = (own[parent[i]][1] if parent[i] >= 0 else None, position.index(i), depth[i])
    return out


def test_threads(spark, tables):
    got, want = run(spark, tables, "op10_quotation_threads"), brute_threads(messages())
    assert len(got) == len(messages())
    for r in got:
        assert (r["parent_turn"], r["position"], r["depth"]) == want.get((r["conv_id"], r["turn"]), (None, None, None))
        assert not r["text"] or not r["text"].startswith(">")


def test_pipeline_stage_by_stage(spark, tables):
    docs, rows = spark.read.parquet(f"{tables[0]}/documents.parquet"), list(tables[1])
    read = lambda df: sorted(((r["doc_id"], r["text"], r["lang"], r["n_chars"]) for r in df.collect()), key=str)
    after = lambda rows: sorted(((d, t, lang, len(t) if t is not None else None) for d, t, lang in rows), key=str)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality rules":
            rows = [r for r, x in zip(rows, brute_judged(rows)) if x and x[3]]
        elif name == "line dedup":
            rows = [(d, t, lang) for (d, t), (_, _, lang) in zip(brute_line_dedup(rows), rows)]
        elif name == "SimHash near-dedup":
            gone = {d for d, _ in brute_groups(rows)}
            rows = [r for r in rows if r[0] not in gone]
        else:
            gone = {(d, t) for d, t in ((x[0], r[1]) for r in rows for x in brute_leaks([r], list(enumerate(items()))))}
            rows = [r for r in rows if (r[0], r[1]) not in gone]
        out = stage(spark, docs, tables[0])
        assert out.columns == docs.columns and out.schema == docs.schema
        assert read(out) == after(rows), name
        docs = simhash.cut(out)
    assert 150 < len(rows) <= len(tables[1]) - 15
    check_bins([r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, docs, tables[0]).collect()], rows, 2048)
    check_bins([r.asDict() for r in corpus_pipeline.run(spark, tables[0]).collect()], rows, 2048)


def test_empty_tables(spark, empty):
    for name, query in queries.queries().items():
        assert query(spark, empty).count() == 0, name
    assert corpus_pipeline.run(spark, empty).count() == 0
