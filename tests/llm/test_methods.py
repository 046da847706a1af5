"""What each method adds, against brute force, planted cases or a plain form of the method."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quarryspark.llm import exact_dedup, html_wrappers, language_id, minhash, packing, pii, quality_rules, queries, sentence_pieces, suffix_dedup

from ..compare import spark_rows, sql_rows


def public(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id")


# --- op1 -----------------------------------------------------------------------------------------------------------


def test_op1_finds_the_tables_secrets_and_leaves_look_alikes(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toPandas().text.fillna("").tolist()
    hit = miss = other = 0
    for t, (base, every) in zip(rows, pii.find_spans(rows, *pii.trained()), strict=True):
        assert set(base) <= set(every)
        planted = {(m.start(1), m.end(1)) for m in re.finditer('(?i)token = "([0-9a-f]{40})"', t)}
        found = {(s, e) for s, e, k in every if k == "secret"}
        hit, miss = hit + len(planted & found), miss + len(planted - found)
        other += len(set(every) - set(base)) - len(found & planted)
    assert hit >= 0.9 * (hit + miss) and hit > 5 and other == 0


PLANTED = {
    "secret": ["api_key = {hex40}", "password: {alnum20}", 'secret "{hex64}"', "Authorization: bearer {jwt}", "key ghp_{alnum160}", "token={b64}"],
    "iban": ["IBAN {iban}", "account {iban}"],
    "ssn": ["SSN 123-45-6789", "social security 321-54-9876"],
    "phone": ["call (415) 555-0199", "phone 415-555-0123", "tel 415.555.0188"],
    "email": ["mail jane.doe22 (at) example (dot) org", "contact bob7 [at] mail [dot] com"],
}
LOOK_ALIKES = ["order 4444 5555 6666", "ISBN 978-3-1614-8410-0", "version 12.345.678", "commit {hex40}", "file path/to/some/long/name22", "on 12-05-2021", "page 1234567890123456", "Ordinary words only"]


def test_op1_recall_by_kind_and_precision():
    r = random.Random(99)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def iban():
        rest = pick("0123456789", 18)
        check = 98 - int("".join(str(int(c, 36)) for c in rest + "DE00")) % 97
        return f"DE{check:02d}{rest}"

    def filled(form):
        return form.format(hex40=pick("0123456789abcdef", 40), hex64=pick("0123456789abcdef", 64), alnum20="x1" + pick(alnum, 18), alnum160=pick(alnum, 160), jwt=f"eyJ{pick(alnum, 30)}.{pick(alnum, 60)}.{pick(alnum, 43)}", b64=pick(alnum + "+/", 43) + "=", iban=iban())

    model = pii.trained()
    for kind, forms in PLANTED.items():
        texts = [f"The ention of it {filled(form)} and the rest." for form in forms for _ in range(30)]
        found = pii.find_spans(texts, *model)
        assert sum(any(k == kind for *_, k in every) for _, every in found) >= 0.9 * len(texts), kind
    texts = [f"The ention of it {filled(form)} and the rest." for form in LOOK_ALIKES for _ in range(30)]
    assert sum(len(every) > 0 for _, every in pii.find_spans(texts, *model)) <= 0.05 * len(texts)


def test_op1_added_spans_overlap_nothing():
    text = "1.2.3.4_5.6.7.8_9.1.2.3_4.5.6.7_8.9.1.2_415-555-1234_@x.com"
    model, calibration, limits = pii.trained()
    [(base, every)] = pii.find_spans([text], model, calibration, dict.fromkeys(limits, 0.0))
    added = set(every) - set(base)
    assert not any(a[0] < b[1] and b[0] < a[1] for a in added for b in every if a != b)


# --- op2 -----------------------------------------------------------------------------------------------------------


def test_op2_phrases_are_those_of_whole_texts(monkeypatch):
    """Lanes are an aid of the computation: phrases that run over their ends count once, texts of the sample are one."""
    monkeypatch.setattr(language_id, "LANE", 16)
    r = random.Random(3)
    sample = [(lang, "".join(r.choice(letters) for _ in range(300))) for lang, letters in (("x", "abcdeé ß"), ("y", "abcxyz ")) for _ in range(6)]
    parser = language_id.CrossParser(sample)
    texts = ["".join(r.choice("abcdeéxyzq ") for _ in range(r.randint(0, 120))) for _ in range(150)] + [sample[0][1] * 2, sample[1][1], ""]
    total, _ = parser.phrases(texts)
    for k, lang in enumerate(parser.langs):
        known = [bytes(parser.encode([t])[0].tolist()) for x, t in sample if x == lang]
        for t, got in zip(texts, total[:, k], strict=True):
            c, n, at = bytes(parser.encode([t])[0].tolist()), 0, 0
            while at < len(c):
                long = 0
                while at + long < len(c) and any(c[at : at + long + 1] in s for s in known):
                    long += 1
                at, n = at + max(1, long), n + 1
            assert got == n


def test_op2_ties_go_to_the_first_language():
    parser = language_id.CrossParser([("b", "same text"), ("a", "same text")])
    assert parser.predict(["same"])[0] == ["a"]


# --- op3 -----------------------------------------------------------------------------------------------------------


def test_op3_program_beats_best_fit_on_a_large_histogram():
    r = random.Random(2)
    h = collections.Counter(min(2048, int(r.lognormvariate(6, 1)) + 1) for _ in range(1200))
    h = {n: 100 * k for n, k in h.items()}
    used, n, bound = packing.plan(h)
    placed = collections.Counter()
    for config, times in used:
        assert sum(config) <= 2048
        for x in config:
            placed[x] += times
    alone = sum(k for _, k in packing.best_fit(h, 2048))
    assert placed == h and bound <= n <= alone


# --- op4 -----------------------------------------------------------------------------------------------------------


def plain_mcd(v):
    """Centre and covariance by concentration steps from two starts, floors as in the operator, in NumPy."""
    p, floor = quality_rules.P, np.array(quality_rules.FLOOR, float)

    def factor(cov):
        c = np.zeros((p, p))
        for i in range(p):
            for j in range(i + 1):
                s = cov[i, j] - c[i, :j] @ c[j, :j]
                c[i, j] = np.sqrt(max(s, floor[i] ** 2)) if i == j else s / c[j, j]
        return c

    def distance(m, c):
        return (np.linalg.solve(c, (v - m).T) ** 2).sum(0)

    def moments(rows, scale):
        return rows.mean(0), factor(scale * (rows.T @ rows / len(rows) - np.outer(rows.mean(0), rows.mean(0))))

    best = None
    middle = np.median(v, 0)
    for m, c in (moments(v, 1.0), (middle, np.diag(np.maximum(1.4826 * np.median(abs(v - middle), 0), floor)))):
        for _ in range(quality_rules.STEPS):
            d = distance(m, c)
            m, c = moments(v[np.argsort(d, kind="stable")[: int(np.ceil(quality_rules.H_SHARE * len(v)))]], quality_rules.CONSISTENT_75)
        det = np.log(np.diag(c)).sum()
        if best is None or det < best[0]:
            best = det, m, c
    d = distance(*best[1:])
    return moments(v[d <= quality_rules.CHI_975], quality_rules.CONSISTENT_975)


def test_op4_verdicts_are_those_of_a_plain_mcd(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_rules.quality_rules(docs).join(docs.select("doc_id", "lang", "source"), "doc_id")
    stats = quality_rules.text_statistics(docs).select("doc_id", *[x.alias(f"v{i}") for i, x in enumerate(quality_rules.transformed())])
    rows = got.where(~F.col("base_failed")).join(stats, "doc_id").toPandas()
    values, same = [f"v{i}" for i in range(5)], 0
    for (_, lang), group in itertools.chain(rows.groupby(["source", "lang"], dropna=False)):
        pool = group if len(group) >= quality_rules.MIN_GROUP else rows[rows.lang == lang]
        m, c = plain_mcd(pool[values].to_numpy(float))
        d = (np.linalg.solve(c, (group[values].to_numpy(float) - m).T) ** 2).sum(0)
        same += ((d <= quality_rules.CHI_REJECT) == group.kept.to_numpy()).sum()
    assert rows.distance2.notna().all() and same >= 0.98 * len(rows)


# --- op5 -----------------------------------------------------------------------------------------------------------


def test_op5_equals_its_sql(spark, sf_dir):
    assert spark_rows(queries.QUERIES["op5_exact_dedup"](spark, sf_dir)) == sql_rows(queries.SQL["op5_exact_dedup"], sf_dir)


def test_op5_index_grows_by_flushes_and_answers_look_ups(spark):
    index = exact_dedup.DigestIndex(spark, keep="smallest")
    texts = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index.flush(texts([(5, "a"), (6, "b")]))
    index.flush(texts([(3, "A"), (9, "c")]))
    index.compact()
    index.flush(texts([(1, "c")]))
    index.compact()
    assert len(index.runs) == 1
    assert sorted((r["doc_id"], r["keep_id"]) for r in index.look_up(texts([(20, "a"), (21, "C"), (22, "new")])).collect()) == [(20, 3), (21, 1)]


# --- op6 -----------------------------------------------------------------------------------------------------------


def article(page):
    """The article of the tables' pages, by their one form of markup."""
    import html

    body = re.search("<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h\d)(?:\s[^>]*)?>", re.sub("(?s)<!--.*?-->", "", body))
    parts = [html.unescape(re.sub("<[^>]+>", lambda m: " " if m[0].startswith("<br") else "", p)) for p in parts]
    return "\n".join(x for x in (" ".join(p.split()) for p in parts) if x)


def without_names(page):
    return re.sub(r"<(/?)(?:nav|article|footer|header|aside|main)\b", r"<\1div", re.sub(' class="[^"]*"', "", page))


def test_op6_equals_brute_force_on_all_pages(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.QUERIES["op6_html_wrappers"](spark, sf_dir).collect()}
    assert got == {i: (article(p), len(article(p))) for i, p in pages.items()}


def test_op6_wrappers_find_what_names_no_longer_tell(spark):
    hosts = collections.defaultdict(list)
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        hosts[r["url"].split("/")[2]].append(r["html"])
    wrong = alone = n = 0
    for pages in hosts.values():
        wrapper = html_wrappers.infer([without_names(p) for p in pages[: html_wrappers.SAMPLE]])
        for p in pages:
            n += 1
            wrong += html_wrappers.main_text(without_names(p), wrapper) != article(p)
            alone += html_wrappers.main_text(without_names(p), None) != article(p)
    assert wrong == 0 and 0 < alone < n  # some pages of short articles need their host's wrapper


def test_op6_deep_markup_and_long_tags_lose_nothing():
    deep = "<html><body>" + "<div>" * 20 + "<article><p>first</p>" + "<div>" * 215 + "deep" + "</div>" * 215 + "<p>last</p></article>"
    assert html_wrappers.main_text(deep, None) == "first\ndeep\nlast"
    assert html_wrappers.main_text(f'<p><a title="{"x>" * 50000}">link</a> text</p>', None) == "link text"
    assert html_wrappers.main_text("<div>" * 50000 + "text", None) == "text"


# --- op7 -----------------------------------------------------------------------------------------------------------


def test_op7_query_columns(spark, sf_dir, docs):
    coder = sentence_pieces.PieceCoder(public("piece_bpe_32k.model"))
    got = queries.QUERIES["op7_sentence_pieces"](spark, sf_dir).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text.fillna(""), strict=True):
        assert got.loc[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    for i, t in zip(docs.doc_id[:40], docs.text[:40], strict=True):
        assert got.loc[i].ids_crc32 == zlib.crc32(np.array(coder.encode([t])[0], "<u4").tobytes())


# --- op8 -----------------------------------------------------------------------------------------------------------


def test_op8_texts_longer_than_a_part(spark, monkeypatch):
    """Runs of parts are those of the whole text, cut in two at most."""
    r = random.Random(5)
    text = bytes(r.choice(b"abcd efgh") for _ in range(5000)) * 2
    whole = {}
    for part in (700, 10**6):
        monkeypatch.setattr(suffix_dedup, "PART", part)
        windows = {}
        for _, begin, what in suffix_dedup._parts([text]):
            of, at, count, v, _, _ = suffix_dedup.runs(what)
            for o, a, c, h in zip(of, at, count, v, strict=True):
                windows.update((begin[o] + a + k, h) for k in range(c))
        whole[part] = windows
    assert whole[700] == whole[10**6] and len(whole[700]) == len(text) - suffix_dedup.LENGTH + 1


# --- op10, pipeline --------------------------------------------------------------------------------------------------


def linked(sets, ids):
    """The least id of each component, by comparing all pairs."""
    least = {i: i for i in ids}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, j in itertools.combinations(ids, 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((root(i), root(j)))
            least[y] = x
    return {i: root(i) for i in ids}


def shingles(text, width):
    w = [x for x in re.split("[\x20\t-\r]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_op10_edited_copies_around_the_limit(spark):
    """Two large groups that share a passage, with copies on both sides of the limit: pairs that bounds rule out have no link."""
    r = random.Random(10)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(2):
        base = shared + [r.choice(vocabulary) for _ in range(60)]
        for _ in range(70):
            copy = list(base)
            for at in r.sample(range(len(copy)), r.randint(0, 14)):
                copy[at] = r.choice(vocabulary[:40])
            texts.append(" ".join(copy))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert got == linked({i: shingles(t, 2) for i, t in enumerate(texts)}, range(len(texts)))


def test_op10_sketches_bound_the_difference():
    r = np.random.default_rng(1)
    for n in (30, 900, 5000):
        a, b = (np.unique(r.integers(0, 1 << 62, n, dtype=np.int64).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[: n // 2], b[: n // 2]]))
        for bits in (1024, 1 << (2 * n - 1).bit_length()):
            x = minhash.sketch(a, bits).view(np.uint64) ^ minhash.sketch(b, bits).view(np.uint64)
            assert sum(int(w).bit_count() for w in x) <= len(np.setxor1d(a, b))


def test_pipeline_equals_brute_force(spark, sf_dir, docs):
    d = {i: t for i, t in zip(docs.doc_id, docs.text, strict=True) if t is not None and any(c.isalpha() for c in t)}
    az = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = {t.translate(az): i for i, t in sorted(d.items())}
    d = {i: d[i] for i in last.values()}
    names = linked({i: shingles(t, 5) for i, t in d.items()}, sorted(d))
    d = {i: t for i, t in d.items() if names[i] == i}
    found = pii.find_spans(list(d.values()), *pii.trained())
    d = {i: pii.redacted(t, every) for (i, t), (_, every) in zip(d.items(), found, strict=True)}
    encoder = packing.WordEncoder(public("word_bpe_49k.json"))
    want = {}
    for i, t in d.items():
        ids = np.array([*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k): (k * 2048, len(ids[k * 2048 :][:2048]), zlib.crc32(ids[k * 2048 :][:2048].tobytes())) for k in range(-(-len(ids) // 2048))}
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want and len(got) == len(want)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 2048 and s.offset.tolist() == [0, *s.length.cumsum()[:-1]]
    assert got.sequence_id.nunique() <= 1.01 * got.length.sum() / 2048 + 1
