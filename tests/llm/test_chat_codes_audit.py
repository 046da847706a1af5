"""Operators 11 to 13: against SQL, plain versions, other parameters and odd rows."""

import hashlib
import random

import numpy as np
import pytest

from quarryspark.llm import chat_format as chat
from quarryspark.llm import cover_tree, queries, source_audit
from tests.compare import spark_rows, sql_rows


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_vector_codes", "op13_source_audit"])
def test_equals_sql(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == sql_rows(queries.SQL[name], sf_dir)


# --- op11 ----------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, key string, piece string, position string, block string, id string"


def turns(rows):
    return [(*r, "k", "p", "q", "b", "i") for r in rows]


def plain_digests(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, *((r[0] or 0), r[1], r[2])))
        loss = "".join(x for _, r, x in own if r == "assistant")
        every = "".join(f"{r}\n{x}\n" for _, r, x in own)
        out.append((conv, len(own), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.instruct([(r, x) for _, r, x in own]))))
    return sorted(out, key=str)


def odd_turns():
    r = random.Random(3)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "<", "[", "]", " ", "[SYS]", "<\\\\/s>", "[\\INST]", "[TEXT]", "a\nb", "é", "[TURN] x [TEXT] "]
    text = lambda: r.choice([None, "", "".join(r.choice(bits) for _ in range(r.randint(0, 12)))])
    roles = ["user", "assistant", "system", "tool", None, "", "[TEXT] </s>", "a [TEXT] b"]
    rows = [(r.choice([1, 2, 3, None, -1]), r.choice([0, 1, 2, None, 7]), r.choice(roles), text()) for _ in range(300)]
    return rows + rows[:20] + [(9, k, "assistant" if k % 2 else "user", text()) for k in range(100)] + [(4, 0, "user", "long " * 300_000), (5, 0, "assistant", None)]


@pytest.mark.parametrize("long", [chat.LONG, 7, 1])
def test_chat_digests_of_odd_turns(spark, long):
    rows = odd_turns()
    got = chat.digests(spark.createDataFrame(turns(rows), TURNS).repartition(5), long=long).drop("rewrites")
    assert sorted(map(tuple, got.collect()), key=str) == plain_digests(rows)
    assert chat.digests(spark.createDataFrame([], TURNS), long=long).count() == 0


def test_chat_escapes_are_reversible_and_hide_marks():
    for _, _, role, text in odd_turns()[:400]:
        written = chat.escape(text or "")
        assert chat.unescape(written) == (text or "") and not any(m in written for m in ("</s>", "<s>", "INST]") if f"[{m}" in written)
        assert chat.unread(chat.instruct([(role or "", text or "")])) == (role or "", text or "")


def test_chat_blocks_and_whole_prefixes_agree(spark):
    docs = spark.createDataFrame(turns(odd_turns()), TURNS)
    whole = chat.Template(chat.instruct, chat.escape, chat.unescape, chat.unread, memory=None)
    assert sorted(map(str, chat.digests(docs, whole).collect())) == sorted(map(str, chat.digests(docs).collect()))


def forgetful(turns):
    """A template that shows only the last answer's thoughts, and ends in an end mark that moves."""
    last = max((k for k, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
    return "".join(f"{r}: {x if k == last or r != 'assistant' else x.split('|')[-1]}\n" for k, (r, x) in enumerate(turns)) + "<eos>"


def test_templates_that_rewrite_history_are_found(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "think|answer"), (1, 2, "user", "more"), (1, 3, "assistant", "again|done"), (2, 0, "user", "only")]
    same = lambda x: x
    t = chat.Template(forgetful, same, same, lambda p: tuple(p.split(": ", 1)), memory=None)
    frame = spark.createDataFrame(turns(rows), TURNS)
    got = {r["conv_id"]: r for r in chat.formatted(frame, t).collect()}
    assert got[1]["text"] == forgetful([r[2:] for r in rows[:4]]) and got[1]["rewrites"]
    assert [got[1]["text"][a:b] for a, b in got[1]["loss"]] == ["again|done"]  # the first answer isn't there as it was
    assert got[2]["text"] == forgetful([("user", "only")])
    marks = {(r["conv_id"], r["position"]): r["rewrites"] for r in chat.pieces(frame, t).collect()}
    assert marks[1, 1] and marks[1, 3]
    assert {r["conv_id"]: r["turns_sha256"] for r in chat.digests(frame, t).collect()}[1] is None


def test_loss_is_only_what_the_template_left_as_it_was(spark):
    """A template that trims texts: a text with white space around it isn't under the mask."""
    trims = lambda ts: "".join(f"<{r}>{x.strip()}</>" for r, x in ts)
    t = chat.Template(trims, str, str, lambda p: ("", p), memory=1)
    frame = spark.createDataFrame(turns([(1, 0, "assistant", " a"), (1, 1, "assistant", "b")]), TURNS)
    row = chat.formatted(frame, t).first()
    assert (row["text"], [row["text"][a:b] for a, b in row["loss"]], row["rewrites"]) == ("<assistant>a</><assistant>b</>", ["b"], False)


# --- op12 ----------------------------------------------------------------------------------------------------------


def plain_codes(rows):
    kept = [(i, [float(x) for x in v], l) for i, v, l in rows if v is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts = np.split(np.floor(np.array([r[1] for r in kept], np.float32).astype(float) * 1024).astype(np.int64), 4, axis=1)
    books = [p[:256].copy() for p in parts]

    def near(p, b):
        return np.array([((x - b) ** 2).sum(axis=1).argmin() for x in p])

    for _ in range(4):
        for p, b in zip(parts, books, strict=True):
            at = near(p, b)
            for e in set(at.tolist()):
                b[e] = p[at == e].sum(axis=0) // (at == e).sum()
    at = [near(p, b) for p, b in zip(parts, books, strict=True)]
    error = sum(((p - b[a]) ** 2).sum(axis=1) for p, b, a in zip(parts, books, at, strict=True)).tolist()
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1)).encode()).hexdigest()
    by = {}
    for r, e in zip(kept, error, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{a[k]:02x}" for a in at), error[k], by[r[2]], digest) for k, r in enumerate(kept)), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, key string, code string, error string, uses string, ids string"


def test_codes_of_odd_vectors(spark, monkeypatch):
    r = np.random.default_rng(1)
    spots = r.normal(size=(12, 8))
    rows = [(int(i), (spots[i % 12] + r.normal(size=8) * (0.01 if i % 3 else 0)).tolist(), None if i % 5 == 0 else int(i % 3)) for i in r.permutation(900)]
    rows += [(7, rows[0][1], 2), (7, rows[0][1], 2), (None, rows[3][1], 1), (2000, None, 1), (2001, [None] + [0.0] * 7, 1), (2002, [float("nan")] * 8, 1), (2003, [float("-inf")] + [1.0] * 7, 1), (2004, [], 1)]
    frame = spark.createDataFrame([(*x, "k", "c", "e", "u", "i") for x in rows], VECTORS).repartition(3)
    want = plain_codes(rows)
    for chunk, leaf in ((4096, 8), (50, 1), (200, 64)):
        monkeypatch.setattr(cover_tree, "CHUNK", chunk)
        monkeypatch.setattr(cover_tree, "LEAF", leaf)
        assert sorted(map(tuple, cover_tree.vector_codes(frame).collect()), key=str) == want
    assert cover_tree.vector_codes(spark.createDataFrame([], VECTORS)).count() == 0
    few = [(1, [1.0, 2.0, 3.0, 4.0], 1, *"abcde"), (2, [1.0, 2.0, 3.0, 4.5], None, *"abcde"), (3, [1.0] * 5, None, *"abcde"), (4, [1.0] * 8, None, *"abcde")]
    assert {x["vec_id"]: x["code"] for x in cover_tree.vector_codes(spark.createDataFrame(few, VECTORS)).collect()} == {1: "00000000", 2: "00000001"}


def test_trees_cover_their_points_and_spare_comparisons():
    r = np.random.default_rng(2)
    points = cover_tree.whole(np.repeat(r.normal(size=(40, 6)), 60, axis=0) + r.normal(size=(2400, 6)) * 0.01)
    tree = cover_tree.build(points)
    assert (tree["points"][tree["place"]] == points).all() and tree["uses"].sum() == len(points)
    for a, b, radius, child, n in zip(*(tree[k].tolist() for k in ("start", "end", "radius", "child", "children")), strict=True):
        d = np.sqrt(((tree["points"][a:b] - tree["points"][a]) ** 2).sum(axis=1))
        assert d.max() <= radius + 1e-9
        if n:  # children partition the node's stretch
            assert [tree["start"][child], *tree["end"][child : child + n]] == [a, *tree["start"][child + 1 : child + n], b]
    book = points[::60]
    nodes, single, computed = cover_tree.assign(tree, book)
    assert computed < len(tree["points"]) * len(book) / 4  # whole subtrees go
    entry, error = cover_tree.codes(tree, book)
    plain = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (entry == plain.argmin(axis=1)).all() and (error == plain.min(axis=1)).all()
    n, s = cover_tree.sums(tree, book)
    assert (n == np.bincount(entry, minlength=len(book))).all() and all((s[e] == points[entry == e].sum(axis=0)).all() for e in range(len(book)))


def test_distances_are_exact_beyond_floats():
    big = np.array([[1 << 27, -(1 << 27), 3], [5, 7, (1 << 27) + 1]])
    assert cover_tree.squared(big, big)[0, 1] == sum(int(x - y) ** 2 for x, y in zip(*big.tolist(), strict=True))
    with pytest.raises(ArithmeticError):
        cover_tree.whole(np.array([1e9]))


# --- op13 ----------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, count string, item string, value string, digest string"


def odd_docs():
    r = random.Random(4)
    words = ["Alpha", "beta", "GAMMA", "délta", "ÉÉ", "x", "naïve", "中文", "don't", "a1b2", "word"]
    text = lambda: r.choice([None, "", "123 !?", "  ".join(r.choices(words, k=r.randint(0, 30)))])
    rows = [(k, text(), r.choice(["en", "de", None, ""]), r.choice(["a", "b", "c", None, "é", "hot", "hot", "hot"])) for k in range(150)]
    rows += rows[:30] + [(500 + k, "copied text of many words and copied words", "en", r.choice("abc")) for k in range(200)]
    rows += [(900, "one source alone alone", "xx", "s"), (901, "", "yy", "s"), (902, None, "yy", "t"), (None, "word " * 200_000, "en", "hot")]
    return rows


@pytest.mark.parametrize("held,cells", [(source_audit.HELD, source_audit.CELLS), (5, 9)])
def test_audit_of_odd_rows(spark, tmp_path, monkeypatch, held, cells):
    monkeypatch.setattr(source_audit, "HELD", held)
    monkeypatch.setattr(source_audit, "CELLS", cells)
    frame = spark.createDataFrame([(*r, 1, "t", "c", "i", "v", "d") for r in odd_docs()], DOCS).repartition(4)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(source_audit.OP13_SQL).fetchall(), key=str)
    assert sorted(map(tuple, source_audit.audit(frame).collect()), key=str) == want and len(want) > 100
    assert source_audit.audit(frame.limit(0)).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    cases = [(1, 1), (1, 3), (2, 3), (10**14 - 1, 10**14), (123_456_789_012, 9 * 10**14), (7, 9 * 10**14), (9 * 10**14, 9 * 10**14)]
    got = [r[0] for r in spark.createDataFrame(cases, "c long, t long").select(source_audit.share(F.col("c"), F.col("t"))).collect()]
    want = [1 + 10**9 * c // t for c, t in cases]
    assert sorted(got) == sorted(want)
    assert source_audit._share(np.array([c for c, _ in cases]), np.array([t for _, t in cases])).tolist() == want
