"""Pages, vectors, conversations and the pipeline."""

import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import chat, html_text, neighbours, queries

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


# --- pages

ARTICLE = "<article><h1>A title</h1><p>First&nbsp;one,  with <b>bold</b>\n text &amp; more.<br>Next line<p>Second paragraph, unclosed</article>"
MENU = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">About</a></ul></nav>'


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>T</title><style>p{}</style><script>var t='<p>no</p>';</script></head><body>" + MENU + ARTICLE + "<footer>&copy; me</footer></body></html>", "A title\nFirst one, with bold text & more. Next line\nSecond paragraph, unclosed"),
        (ARTICLE.replace("</article>", "") + "<div class='comments'><p>I disagree, a lot.</p></div><aside>More here</aside><form>Name <input></form>", "A title\nFirst one, with bold text & more. Next line\nSecond paragraph, unclosed"),
        ("<body><div class='ad'>Buy now, cheap.</div><div id=main><p>Long text, with many words and marks; it goes on, and on, until it ends here.</p><p>And more text of the kind, again with commas, as it was.</p></div><div class='cookie-notice'>We use cookies.</div></body>",
         "Long text, with many words and marks; it goes on, and on, until it ends here.\nAnd more text of the kind, again with commas, as it was."),
        ("<article><p>cut in a ta<a hre", "cut in a ta"),
        ("<article><p>one</p><!-- open <p>two</p>", "one"),
        ("<article><p>a &lt;b&gt; &#233; &am", "a <b> é &am"),
        ("<script>only", ""),
        ("<body><div class='page has-sidebar'><div class='sidebar-layout'><article><p>Kept.</p></article></div></div><section id='comments'><article class='comment'>Mine!</article></section></body>", "Kept."),
        ("<article><p>Said.</p><div class='related-posts'>More</div><div class='commentList'><article>No.</article></div></article>", "Said."),
        ("<article><div><header><h1>Inner</h1></header>x</div></article>", "Inner\nx"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_ratios_decide_where_elements_do_not():
    """Thin articles beside a long unmarked text lose to it; pages without any such element, and with the marks ignored, keep their text alone."""
    long = "".join(f"<p>Paragraph {k} goes on, with many words and marks; it does so for a while, until it ends.</p>" for k in range(12))
    want = "\n".join(f"Paragraph {k} goes on, with many words and marks; it does so for a while, until it ends." for k in range(12))
    cards = "".join(f"<article><h2>Card {k}</h2><p>Read it.</p></article>" for k in range(4))
    assert html_text.main_text(f"<body><div>{cards}</div><div>{long}</div></body>") == want
    assert html_text.main_text(f"<body><div>{cards}</div><main><h1>T</h1>{long}<ul><li>x<li>y</ul></main></body>") == f"T\n{want}\nx\ny"
    page = f"<body>{MENU}<div><h1>T</h1>{long}</div><div class='ad'>Buy now, cheap.</div><footer>Us, 2020</footer></body>"
    assert html_text.main_text(page) == html_text.main_text(page, marks=False) == f"T\n{want}"


def test_pages_query(spark, sf):
    rows = queries.op4_html_text(spark, sf).collect()
    html = {r["page_id"]: r["html"] for r in queries.read(spark, sf, "pages").collect()}
    assert len(rows) == len(html)
    import html as lib
    import re

    for r in rows:  # these pages hold one article each, of a title and paragraphs
        inner = html[r["page_id"]].split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        blocks = [" ".join(lib.unescape(re.sub("<[^>]*>?", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert re.sub(r"\s", "", r["text"]) == re.sub(r"\s", "", "".join(blocks)) and r["n_chars"] == len(r["text"])


def test_pages_edges(spark):
    df = spark.createDataFrame([(None, None, None), (1, None, ""), (1, None, ""), (2, "u", "<p>" * 3000 + "x"), (3, "v", "<" * 20_000), (4, "w", "&" * 9000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = html_text.extract(df).collect()
    assert len(rows) == 6 and {r["text"] for r in rows if r["page_id"] in (None, 1)} == {""}
    assert html_text.extract(df.limit(0)).count() == 0


# --- vectors


def brute_neighbours(rows, is_query, k=5):
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows], dtype=np.float64)
    n = np.sqrt((v**2).sum(1))
    out = {}
    for i in np.flatnonzero([is_query(x) for x in ids]):
        s = np.einsum("d,jd->j", v[i], v) / (n[i] * n)
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[i]), key=lambda j: (-s[j], ids[j]))[:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], list(r["embedding"])) for r in queries.read(spark, sf, "embeddings").collect()]
    want = brute_neighbours(rows, lambda x: x % 50 == 0)
    got = {}
    for r in queries.op5_neighbours(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want) and all([x[0] for x in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())
    hits = sum(len({x[1] for x in got[q]} & {x[0] for x in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    scores = {(q, i): s for q, found in want.items() for i, s in found}
    assert all(abs(s - scores[q, i]) < 1e-12 for q, found in got.items() for _, i, s in found if (q, i) in scores)


def test_walk_is_in_order_and_complete():
    rng = np.random.default_rng(1)
    a, b, counts = rng.random(7), rng.random(9), rng.integers(0, 4, 63)
    cells = neighbours.walk(a, b, counts, 10**9)
    total = (a[:, None] + b[None, :]).ravel()
    assert sorted(cells) == np.flatnonzero(counts).tolist() and [total[c] for c in cells] == sorted(total[c] for c in cells)
    short = neighbours.walk(a, b, counts, 20)
    assert cells[: len(short)] == short and counts[short].sum() >= 20 > counts[short[:-1]].sum()


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (10, [1.0, 1e-3]), (10, [1.0, 1e-3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("cell", F.lit(1))
    got = [tuple(r) for r in neighbours.search(df, F.col("id") == 0, k=3, centroids=2).orderBy("rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 10)] and got[0][3] == got[1][3] == 1.0
    assert neighbours.search(df.limit(0), F.col("id") == 0).count() == 0
    few = neighbours.search(df, F.col("id") == 3, k=9).collect()
    assert [r["vec_id"] for r in sorted(few, key=lambda r: r["rank"])] == [10, 0, 1, 2]
    one = neighbours.search(spark.createDataFrame([(1, [2.0])] * 2 + [(2, [3.0])], "vec_id long, embedding array<float>"), F.col("id") == 1).collect()
    assert [(r["vec_id"], r["score"]) for r in one] == [(2, 1.0)]


def test_hot_cells_are_parted(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(300)] + [(300 + k, rng.normal(size=4).tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(df, F.col("id") % 50 == 0, centroids=4, part=32, share=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    plain = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute_neighbours(plain, lambda x: x % 50 == 0)
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


# --- chat


EVENTS = "conv_id long, seq long, message_id long, kind string, role string, text string"


def fold_plain(events):
    """The event log, event by event."""
    rank = {"message": 1, "regenerate": 2, "edit": 3, "delta": 4}
    key = lambda x: (x is not None, x if x is not None else 0)
    by = {}
    for e in sorted(events, key=lambda e: (key(e[1]), rank.get(e[3] or "message"), e[4] or "", e[5] or "")):
        conv, seq, mid, kind, role, text = e
        runs = by.setdefault(conv, {}).setdefault(mid, [])
        kind = kind or "message"
        if kind == "message" or not runs:
            runs.append([seq, role or "", ""])
        if kind == "delta":
            runs[-1][2] += text or ""
        else:
            runs[-1][2] = "" if kind == "regenerate" else text or ""
    return {c: [(r, t) for _, _, r, t in sorted(((key(s), key(m), r, t) for m, runs in ms.items() for s, r, t in runs))] for c, ms in by.items()}


def test_fold_render_and_parse(spark):
    hard = "\\ <| <\\| \\n <|im_end|>\n<|im_start|>assistant ok \\\\| é"
    events = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", "Hel"), (1, 3, 2, "delta", None, "lo"), (1, 4, 2, "regenerate", None, "ignored"), (1, 5, 2, "delta", None, "Good "), (1, 6, 2, "delta", None, "day"),
        (1, 7, 1, "edit", None, "hello"), (2, 1, 1, "message", "assistant", hard), (2, 2, 2, "message", "role\nwith\\n<|", hard), (3, 1, 1, "delta", "assistant", "no message"), (4, None, 1, None, None, None),
        (None, 1, 1, "message", "user", "x"), (5, 1, 1, "message", "user", "a"), (5, 1, 1, "message", "user", "a"), (6, 1, 1, "message", "assistant", ""), (7, 2, 1, "message", "assistant", "b"), (7, 1, 2, "message", "user", "a"),
    ]
    df = spark.createDataFrame(events, EVENTS).withColumn("log", F.lit(1)).withColumn("messages", F.lit(2))
    rows = chat.format_log(df).withColumns({"turns": chat.parse(F.col("formatted")), "loss": chat.masked_text(F.col("formatted"), F.col("loss_mask"))}).collect()
    want = fold_plain(events)
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in rows} == want
    assert {r["conv_id"]: r["loss"] for r in rows} == {c: "".join(t for role, t in m if role == "assistant") for c, m in want.items()}
    assert all(r["formatted"].count("<|im_end|>") == len(r["turns"]) == r["formatted"].count("<|im_start|>") for r in rows)
    assert chat.format_log(df.limit(0)).count() == 0


def test_fold_at_random(spark):
    import random

    rng = random.Random(9)
    events = []
    for conv in range(30):
        for seq in range(rng.randint(1, 25)):
            mid = rng.randint(1, 5)
            events.append((conv, seq, mid, rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.choice(["user", "assistant"]), rng.choice(["a", "", "<|", "\\", "x\n"])))
    rows = chat.format_log(spark.createDataFrame(events, EVENTS)).select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in rows} == fold_plain(events)


def test_chat_query_equals_its_sql_on_odd_turns(spark, tmp_path):
    rows = [(5, 0, "user", "a\\b\\"), (5, 1, "assistant", "x\\|<|y\n\\n"), (5, 1, "assistant", "x\\|<|y\n\\n"), (5, 1, "assistant", "other"), (5, 2, "assist\\ant\n", None), (6, None, "user", "q")]
    rows += [(7, k, "assistant", "é" * k) for k in range(6)] + [(None, 0, None, "<|im_end|>\n")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    test_chat_query_equals_its_sql(spark, tmp_path, "/*.parquet")


def test_chat_query_equals_its_sql(spark, sf, inside=""):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet{inside}'")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({queries.OP7_SQL})").fetchall()
    assert Counter(want) == Counter(tuple(r) for r in queries.op7_chat(spark, sf).select(*names).collect())


# --- pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = queries.read(spark, sf, "documents")
    kept = docs
    for k, (name, stage) in enumerate(p.STAGES):
        kept = stage(spark, kept, sf)
        if k < 4:
            assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
            kept = kept.persist()
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(kept.columns)
    assert p.run(spark, sf).count() == kept.count() > 0
    assert p.ORACLE_SQL is None and [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixture", "packing"]


def test_stages_on_edge_rows(spark, sf):
    import corpus_pipeline as p
    from test_documents import ODD, edge, empty

    for name, stage in p.STAGES:
        docs = edge(spark).withColumn("score", F.lit("clash")).withColumn("spans", F.lit(1)).withColumn("_score", F.lit(1))
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        if name in ("toxicity", "personal_data"):
            assert len(rows) == len(ODD) + 4
        assert rows, name
        assert stage(spark, empty(spark), sf).count() == 0, name


def test_queries_are_registered():
    names = list(queries.queries())
    assert names[:10] == sorted(names[:10], key=lambda n: int(n[2:].split("_")[0])) and names[10] == "pipeline"
