"""Operators on embeddings, pages and conversations, and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.llm import ann, chat, embedding_dedup, html_text
from winnow.llm import queries as llm_queries


def clustered(n, groups=0, seed=0, dim=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    for g in range(groups):
        at = r.choice(n, 12, replace=False)
        x[at] = r.normal(size=dim) + 0.2 * r.normal(size=(12, dim))
    return x.astype(np.float32)


BAD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 16, 1), (9004, [float("nan")] * 16, 1), (9005, [float("inf")] + [1.0] * 15, 1), (9006, [None] + [1.0] * 15, 1), (9007, [1.0] * 3, 1), (None, [1.0] * 16, 1), (9008, [2.0] * 16, None)]
SCHEMA = "vec_id long, embedding array<float>, label int, times int, cell int, part int, n long"


def embeddings(rows, data):
    return rows([(i, v, label, 0, 0, 0, 0) for i, v, label in data], SCHEMA)


@pytest.mark.parametrize("choices", [(1,), (8,), embedding_dedup.CELLS])
def test_near_embeddings_brute_force(rows, monkeypatch, choices):
    monkeypatch.setattr(embedding_dedup, "_TILE", 32)
    x = clustered(260, groups=8)
    x[200:210] = x[0]
    labels = [int(i) % 3 if i >= 12 else 1 for i in range(260)]
    data = [(i, x[i].tolist(), labels[i]) for i in range(260)]
    got = {r.vec_id: r for r in embedding_dedup.near_embeddings(embeddings(rows, data + BAD), block=64, choices=choices).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(links, False)
    label = np.arange(260)
    for _ in range(260):
        label = np.minimum(label, np.where(links, label[None, :], 999).min(axis=1))
    assert links.sum() > 50
    for i in range(260):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i].sum(), label[i], label[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i, _, _ in BAD)


@pytest.mark.parametrize("large", [embedding_dedup.LARGE, 50])
def test_multiples_of_one_vector_are_linked(rows, large):
    """Centroids that are the same but for rounding: wherever a vector lies, it meets all others."""
    x = np.random.default_rng(3).normal(size=16)
    data = [(i, (x * (1 + 0.37 * i)).tolist(), 1) for i in range(300)]
    got = embedding_dedup.near_embeddings(embeddings(rows, data), block=64, choices=(8,), large=large, sending=0).collect()
    assert len(got) == 300 and all((r.n_links, r.component_id) == (299, 0) for r in got)


def test_large_cells_are_divided_again(spark, monkeypatch):
    """Few cells of 8,000 vectors, divided by samples of 1,000 of their own; guests of the cells and copies included."""
    n, r = 8_000, np.random.default_rng(13)
    x = r.normal(size=(200, 24))[np.arange(n) % 200] + r.choice([0.05, 0.2, 0.4], size=(n, 1)) * r.normal(size=(n, 24))
    x[5_000:5_900] = x[17]
    seen = []
    divided = embedding_dedup.divided

    def spy(*a):
        out = divided(*a)
        seen.extend(out.groupBy("cell", "sub").agg(F.count_if("guest").alias("guests")).collect())
        return out

    monkeypatch.setattr(embedding_dedup, "divided", spy)
    got = embedding_dedup.near_embeddings(wide(spark, x, lambda i: F.lit(1)), sample=1_000, block=256, choices=(2, 8), large=1_000, sending=0).toPandas().sort_values("vec_id")
    assert len(seen) > len({s.cell for s in seen}) and sum(s.guests for s in seen) > 0
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = np.concatenate([(u[i : i + 2000] @ u.T >= 0.93).sum(axis=1) - 1 for i in range(0, n, 2000)])
    assert (got.n_links.to_numpy() == links).all() and links.sum() > 100_000


def test_many_cells_and_blocks_at_shipped_settings(spark, monkeypatch):
    """20,000 clustered vectors: several cells pay off, and every link is found."""
    n, r = 20_000, np.random.default_rng(12)
    centres = r.normal(size=(400, 32))
    x = centres[np.arange(n) % 400] + r.choice([0.05, 0.14, 0.4], size=(n, 1)) * r.normal(size=(n, 32))
    chosen = []
    fit = embedding_dedup.fit_cells
    monkeypatch.setattr(embedding_dedup, "fit_cells", lambda *a: chosen.append(fit(*a)) or chosen[-1])
    got = embedding_dedup.near_embeddings(wide(spark, x, lambda i: F.lit(1)), block=512).toPandas().sort_values("vec_id")
    assert len(chosen) == 1 and len(chosen[0]) >= 32
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = np.concatenate([(u[i : i + 2000] @ u.T >= 0.93).sum(axis=1) - 1 for i in range(0, n, 2000)])
    assert (got.n_links.to_numpy() == links).all() and links.sum() > 100_000
    assert (got.component_id <= got.vec_id).all() and (got.kept == (got.component_id == got.vec_id)).all()


def wide(spark, x, label):
    """Vectors as rows, by way of Arrow."""
    import pyarrow as pa

    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))}))
    return df.withColumn("label", label("vec_id").cast("int"))


@pytest.mark.parametrize(("spread", "scanned"), [(0.4, 0.25), (None, 1.0)])
def test_search_at_shipped_settings(spark, monkeypatch, spread, scanned):
    """50,000 vectors, in clusters and without: recall, and the share of the vectors that a query meets."""
    n, r = 50_000, np.random.default_rng(4)
    x = r.normal(size=(n, 24)) if spread is None else r.normal(size=(300, 24))[r.integers(0, 300, n)] + spread * r.normal(size=(n, 24))
    routers = []
    fit = ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a: routers.append(fit(*a)) or routers[-1])
    got = ann.search(wide(spark, x, lambda i: F.lit(1)), F.col("vec_id") % 100 == 0).toPandas()
    x = x.astype(np.float32).astype(np.float64)
    asked = np.arange(0, n, 100)
    true = ann.neighbours(x, x[asked], 10, asked)
    found = got.groupby("query_id").vec_id.agg(set)
    assert np.mean([len(found[q] & set(t.tolist())) / 10 for q, t in zip(asked, true, strict=True)]) >= 0.9
    assert routers[0].parts == 45 and routers[0].probes / routers[0].parts <= scanned


def test_every_table_is_divided():
    assert [ann.partitions(t, min(t, ann.SAMPLE)) for t in (0, 1, 60, 500, 2000, 50_000, 10**6, 10**9)] == [1, 1, 2, 4, 9, 45, 200, 256]


def test_guests_lose_no_link():
    x = clustered(400, groups=20, seed=3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = embedding_dedup.spherical_k_means(u, 12)
    home, to = embedding_dedup.guests(u, c, 0.93)
    i, j = np.nonzero(u @ u.T >= 0.93)
    for a, b in zip(i, j, strict=True):
        assert home[a] == home[b] or to[a, home[b]] or to[b, home[a]]


def test_search_recall_and_order(rows):
    x = clustered(3000, groups=30, seed=2)
    data = [(i, x[i].tolist(), 0) for i in range(3000)]
    got = ann.search(embeddings(rows, data + BAD), F.col("vec_id") % 20 == 0).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hit = 0
    for q in range(0, 3000, 20):
        own = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1))
        assert all(abs(r.score - d[r.vec_id]) < 1e-12 and r.vec_id != q for r in own)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        d[q] = np.inf
        hit += len({r.vec_id for r in own} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hit / 1500 >= 0.9
    assert not {r.vec_id for r in got} & {i for i, _, _ in BAD}


def test_search_ties_and_few_candidates(rows):
    data = [(i, [1.0, 2.0], 0) for i in range(30)]
    got = ann.search(embeddings(rows, data), F.col("vec_id") == 20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(10)) and all(r.score == 0 for r in got)
    few = ann.search(embeddings(rows, [(100, [1.0], 0), (1, [2.0], 0)]), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(100, 1, 1, 1.0)]
    assert ann.search(embeddings(rows, []), F.lit(True)).count() == 0
    assert embedding_dedup.near_embeddings(embeddings(rows, [])).count() == 0


def test_balanced_partitions():
    x = clustered(600, groups=10, seed=1).astype(np.float64)
    graph = ann.neighbours(x, x, 5, np.arange(600))
    part = ann.balanced_partitions(x, graph, 6)
    assert np.bincount(part).tolist() == [100] * 6
    cut = (part[graph] != part[:, None]).mean()
    assert cut < np.mean([(np.random.default_rng(s).permutation(part)[graph] != part[:, None]).mean() for s in range(3)])


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav>
<div class="ad">Buy now, really.</div><article><h1>A  headline
here</h1><p>First &amp; foremost, a paragraph with some words in it.<p>Second one&nbsp;with <b>bold</b> text, and more words, to read.</p>
<script>var t = "</p>"; track(1);</script><ul><li>An item of a list in it<li>and another item of it</ul></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>Anna</p><p>I liked it.</p></div></section>
<form class="newsletter"><label>Mail</label><input><p>Subscribe to our letter.</p></form><footer>&copy; 2024 Example &middot; all rights reserved.</footer></body></html>"""


def test_main_text():
    got = html_text.main_text(PAGE, html_text.trained_field())
    assert got == "A headline here\nFirst & foremost, a paragraph with some words in it.\nSecond one with bold text, and more words, to read.\nAn item of a list in it\nand another item of it"


def test_held_out_pages():
    model, right, all_ = html_text.trained_field(), 0, 0
    for page, labels in html_text.labelled_pages(150, seed=77):
        got = model.decode(html_text.features(html_text.blocks(page)))
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        all_ += len(labels)
    assert right / all_ > 0.98


def test_viterbi_brute_force():
    from itertools import product

    model = html_text.Field({"a": 1.3, "b": -0.7, "c": 0.2}, ((0.5, -0.4), (-0.9, 0.6)))
    r = random.Random(0)
    for _ in range(50):
        rows = [[r.choice("abc") for _ in range(r.randint(1, 3))] for _ in range(r.randint(1, 7))]

        def score(labels, rows=rows):
            own = sum(sum(model.weights[f] for f in x) for x, label in zip(rows, labels, strict=True) if label)
            return own + sum(model.pairs[p][q] for p, q in zip(labels, labels[1:], strict=False))

        best = max(product([0, 1], repeat=len(rows)), key=score)
        assert abs(score(best) - score(model.decode(rows))) < 1e-9


def test_pages_odd_rows(rows):
    data = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p", "x"), (3, "u", "plain text without any markup, but quite a few words.", "x"), (3, "u", "<div><b>" * 2000 + "x" * 100_000, "x")]
    got = html_text.extract(rows(data, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""]


CHATS = "conv_id long, turn long, role string, text string, key string, place int, n_turns int"


def talk(rows, data):
    return rows([(*x, "k", 1, 2) for x in data], CHATS)


def brute_chats(data):
    turns: dict = {}
    for c, t, r, x in set(data):
        turns.setdefault(c, []).append((t, r, x))
    low = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, v or "")
    whole = {c: [(r, x) for t, r, x in sorted(v, key=lambda y: (low(y[0]), text(y[1]), text(y[2])))] for c, v in turns.items()}
    out = {}
    for c, v in whole.items():
        longer = any(len(w) > len(v) and w[: len(v)] == v for w in whole.values())
        same = [d for d, w in whole.items() if w == v]
        if not longer and c == min(same, key=lambda d: (d is None, d or 0)):
            out[c] = "".join(f"<|im_start|>{r if r is not None else 'unknown'}\n{x or ''}<|im_end|>\n" for r, x in v)
    return out


def test_chats_brute_force(rows):
    r = random.Random(8)
    data = []
    for c in range(60):
        for t in range(r.randint(1, 6)):
            data.append((c, t, "user" if t % 2 == 0 else "assistant", r.choice(["a", "b"]) if t else "hello"))
    data += [(70, None, None, None), (71, None, "user", None), (72, 0, "user", ""), (None, 0, "user", "hello"), (None, 1, "assistant", "zz"), (73, 0, "user", "tie"), (73, 0, "user", "tie"), (73, 0, "user", "other"), (74, 0, "user", "x" * 50_000)]
    got = chat.format_chats(talk(rows, data)).collect()
    assert {x.conv_id: x.rendered for x in got} == brute_chats(data)


def test_long_chats_take_several_rows(rows):
    data = [(1, t, "user", f"t{t}") for t in range(300)] + [(2, t, "user", f"t{t}") for t in range(299)]
    got = chat.format_chats(talk(rows, data), turns_a_row=64).orderBy("part").collect()
    assert {x.conv_id for x in got} == {1} and [x.part for x in got] == [0, 1, 2, 3, 4]
    assert "".join(x.rendered for x in got) == brute_chats(data)[1]
    assert chat.format_chats(talk(rows, [])).count() == 0


def test_queries_are_registered():
    names = set(llm_queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
    assert set(llm_queries.oracle_sql()) <= names


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>a</p><svg-icon></svg-icon><p>b</p><svg><title>t</title></svg><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><audio-player></audio-player><button-group></button-group><p>b</p>", ["a", "b"]),
        ('<p>a</p><svg viewBox="0 0 1 1"/><script src="x"/><p>b</p>', ["a", "b"]),
        ("<p>a <math><mi>x</mi><annotation>tex</annotation></math> c</p>", ["a x c"]),
        ("<p>a</p><button><p>b</p><button>more</button><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><object>o<object>i</object>o</object><p>b</p><object><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><script>'</svg><p>b</p>'</script><p>c</p><style>d", ["a", "c"]),
    ],
)
def test_unread_elements_end_where_they_do(page, texts):
    assert [b.text for b in html_text.blocks(page)] == texts


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts = ["Le chat dort sur la table du salon tous les jours. " * 4, "The cat sleeps on the table in the room every day of it. " * 4, "1234 5678", None]
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(400)]
    data = [(i, texts[i], ["fr", "en", "en", None][i], "s0", 1, "x") for i in range(4)]
    data += [(10 + i, " ".join(words[(i * 13 + j * (3 + 2 * i)) % 400] for j in range(80)), "en", f"s{i % 3}", 1, "x") for i in range(40)]
    data += [(100 + i, data[6][1] + " end", "en", "s1", 1, "x") for i in range(3)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "mixing", "packing"]
    told = stages["language"](spark, docs, str(tmp_path))
    assert told.columns == docs.columns and {r.doc_id for r in told.collect()} == {r[0] for r in data} - {2, 3}
    kept = stages["near_duplicates"](spark, told, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in data} - {2, 3, 100, 101, 102}
    mixed = stages["mixing"](spark, kept, str(tmp_path))
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in kept.collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_chat_sql_with_long_conversations(spark, tmp_path):
    """Conversations of 700, 300 and 256 turns, the second a prefix of the first: rows of 256 turns, as in the SQL."""
    import duckdb

    data = [(c, i, "user" if i % 2 else None, f"{'ab'[c == 4]} says {i}") for c, n in ((1, 700), (2, 300), (3, 256), (4, 257)) for i in range(n)]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = llm_queries.queries()["op4_chat_snapshot_collapse"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(llm_queries.oracle_sql()["op4_chat_snapshot_collapse"]).fetchall())
    assert sorted((r.conv_id, r.part) for r in got) == [(1, 0), (1, 1), (1, 2), (4, 0), (4, 1)]


@pytest.mark.parametrize("spread", [0.4, None])
def test_search_on_two_levels(spark, spread):
    """12,000 vectors of which a sample of 1,500 tells at most 6 partitions apart, so that each is divided again:
    the recall holds, and of clustered vectors fewer are met than on one level."""
    n, r = 12_000, np.random.default_rng(31)
    x = r.normal(size=(n, 24))
    if spread:
        x = r.normal(size=(80, 24))[np.arange(n) % 80] + spread * x
    df = wide(spark, x, lambda i: F.lit(1))
    asks, met = np.arange(0, n, 40), {}
    x = x.astype(np.float32).astype(np.float64)
    d = ((x[asks][:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    d[np.arange(len(asks)), asks] = np.inf
    true = np.argsort(d, axis=1)[:, :10]
    for roots in (5, 18):  # at 18 roots a partition no more than one level is wanted
        with pytest.MonkeyPatch.context() as m:
            m.setattr(ann, "ROOTS", roots)
            calls = []
            divide = ann.divided
            m.setattr(ann, "divided", lambda *a: calls.append(divide(*a)) or calls[-1])
            got: dict = {}
            for g in ann.search(df, F.col("vec_id") % 40 == 0, sample=1500, most=6).collect():
                got.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
            recall = np.mean([len({v for _, v, _ in got[int(q)]} & set(true[i].tolist())) for i, q in enumerate(asks)]) / 10
            assert recall >= 0.9 and all([a for a, _, _ in sorted(v)] == list(range(1, 11)) for v in got.values())
            assert all(abs(s - np.sqrt(((x[q] - x[v]) ** 2).sum())) < 1e-9 for q, rows_ in got.items() for _, v, s in rows_)
            assert bool(calls) == (roots == 5)
            if calls:
                met[roots] = calls[0].groupBy("part", "sub").agg(F.count_if("asked").alias("a"), F.count_if(~F.col("asked")).alias("c")).selectExpr("sum(a * c) as met", "count(*) as parts").first()
    assert met[5].parts > 12 and (spread is None or met[5].met < 0.35 * n * len(asks))


def test_tables_on_the_way_are_removed(spark, rows, tmp_path):
    """What operators write on their way is gone once nothing reads it; what their results rest on stays."""
    from pathlib import Path

    from winnow.llm import token_cache
    from winnow.llm.shared import run_dir

    top = Path(run_dir(spark).removeprefix("file:"))
    before = {p.name for p in top.iterdir()} if top.exists() else set()
    left = lambda: sorted(p.name.rsplit("-", 1)[0] for p in top.iterdir() if p.name not in before)
    x = clustered(120, groups=3)
    df = embeddings(rows, [(i, x[i].tolist(), 1) for i in range(120)])
    near = embedding_dedup.near_embeddings(df)
    assert left() == ["named"] and near.count() == 120
    found = ann.search(df, F.col("vec_id") % 10 == 0)
    assert left() == ["named", "routed"] and found.count() == 120
    counts = token_cache.count_tokens(rows([(1, "a b"), (2, "a b"), (3, None)], "doc_id long, text string"), str(tmp_path / "cache"))
    assert left() == ["counts", "named", "routed"] and counts.count() == 3
