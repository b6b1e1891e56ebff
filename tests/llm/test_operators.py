"""Edge cases and brute-force comparisons on small fixtures."""

import hashlib
import io
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import (
    decontamination, html_text, near_duplicates, packing, quality_classifier, quality_rules, sharding, tokens, toxicity, warc,
)
from lodestrata.llm.queries import tokenizer_path

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node string"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("alpha beta gamma delta omega kappa sigma theta lambda ärger été".split()) + str(r.randrange(400)) for _ in range(n)]


def documents(spark, rows):
    """Rows (id, text, source) with extra columns whose names clash with operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), None, "x") for i, t, s in rows], FIELDS)


@pytest.fixture(scope="module")
def texts():
    base = " ".join(words(200, 1))
    near = base.replace(base.split()[50], "changed", 1)
    long = " ".join(words(6000, 2))
    return [
        (1, base, "a"), (2, base, "a"), (3, near, "b"), (4, None, "a"), (5, "", None), (6, "one two", "a"), (7, "one two", "b"), (8, long, "a"),
        (9, "x y z w v " * 40, "a"), (10, "Line one here\nsame line of words\nsame line of words\n\t \nMore *** text & symbols", "b"), (10, "repeated id " + base, "b"), (None, "null id text of some words", "a"),
        (11, " ".join(words(60, 3)), "a"), (1, base, "a"),
    ]


def numpy_free_metrics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)} if len(grams) < 800 else set()
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_metrics(spark, texts):
    rows = quality_rules.base_metrics(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, repeat = numpy_free_metrics(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (n, chars, symbols, dup)
        if n < 800:
            assert r["n_repeat_words"] == repeat
        assert r["base_failed"] == (n < 10 or 100 * r["n_repeat_words"] > 20 * n)


def test_frequent_lines_are_removed_and_depleted_documents_rejected(spark):
    menu = "home about contact menu links of the site here today now"
    rows = [(i, f"{menu}\n" + " ".join(words(40, 100 + i)), "h") for i in range(6)] + [(50, menu + "\nonly this", "h"), (51, menu, "other"), (60, None, None)]
    limits = quality_rules.LineLimits(min_texts=3, per_mille=1)
    out = {r["doc_id"]: r for r in quality_rules.judge(documents(spark, rows), limits=limits).withColumn("clean", quality_rules.without_lines(F.col("text"), F.col("removed_hashes"))).collect()}
    assert all(out[i]["kept"] and menu not in out[i]["clean"] for i in range(6))
    assert out[50]["depleted"] and not out[50]["kept"]
    assert out[51]["kept"] and out[51]["clean"] == menu
    # Copies of one text count once.
    same = quality_rules.judge(documents(spark, [(i, menu + "\n" + " ".join(words(30, 7)), "h") for i in range(9)]), limits=limits)
    assert same.where("kept").count() == 9


def test_warc_round_trip(spark):
    body = "<p>" + "é" * 80 + "</p>"
    rows = [(3, "u", body, 1), (1, "u\r\nx", body, 1), (2, None, "short", 1), (4, "u", "short", 1), (5, "u", None, 1), (1, "u", body, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(pages.select("page_id", "url", "html")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    n = len(body.encode())
    assert got == {
        (1, n, sha(body), "response", None), (3, n, sha(body), "revisit", 1), (2, 5, sha("short"), "response", None),
        (4, 5, sha("short"), "response", None), (5, 0, sha(""), "response", None),
    }
    assert warc.archive_round_trip(pages.select("page_id", "url", "html").limit(0)).count() == 0


def test_normaliser_gives_members_that_stand_alone():
    payloads = [b"a" * 10, b"", bytes(range(256)) * 500]
    engine, raw = zlib.compressobj(6, zlib.DEFLATED, 31), b""
    for i, p in enumerate(payloads):
        raw += engine.compress(warc.record("response", f"urn:test:{i}", i, "u", "d", len(p), None, p))
    raw += engine.flush()
    out = io.BytesIO()
    index = list(warc.normalise(io.BytesIO(raw).read, out.write))
    for i in (2, 0, 1):
        assert warc.read_record(out, *index[i][2:])[1] == payloads[i]
    assert [p for _, p, _ in warc.records(warc.inflate(io.BytesIO(out.getvalue()).read))] == payloads


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 17, 100, 1000])
def test_sharding_is_a_permutation(spark, rows):
    docs = spark.range(rows).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("shard"))
    got = sharding.shard(docs, shards=8, seed=5).collect()
    assert sorted(r["position"] for r in got) == list(range(rows)) == sorted(r["row_number"] for r in got)
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - rows / 8) < 1


def test_sharding_edge_rows(spark, texts):
    got = sharding.shard(documents(spark, texts)).collect()
    assert len(got) == len(texts) and sorted(r["position"] for r in got) == list(range(len(texts)))
    assert {(r["size"], r["text_crc32"]) for r in got} == {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in texts}


def test_tokens_round_trip(spark, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    odd = [(20, "it's WE'LL 3rd <|endoftext|> ΣΑΣ naïve—“q” 東京 😀 a b\x1cc", "a")]
    rows = tokens.token_digests(documents(spark, texts + odd).select("doc_id", "text"), tokenizer_path()).collect()
    assert len(rows) == len(texts) + 1
    starts = sorted((r["start"], r["n_tokens"]) for r in rows)
    at = 0
    for start, n in starts:
        assert start == at
        at += n
    want = sorted((i if i is not None else -1, len(plain.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in texts + odd)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in rows) == want
    assert tokens.token_digests(documents(spark, texts).limit(0).select("doc_id", "text"), tokenizer_path()).count() == 0


def test_packing(spark, texts):
    rows = packing.pack(documents(spark, texts), tokenizer_path()).collect()
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), 0)
        pieces[r["doc_id"], r["doc_tokens"]] += r["length"]
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(pieces.values()) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)


def test_differencing_is_near_equal():
    sizes = [random.Random(4).randrange(1, 700) for _ in range(200)]
    found = packing.windows(sizes)
    assert sorted(i for m in found for i in m) == list(range(200))
    sums = [sum(sizes[i] for i in m) for m in found]
    assert max(sums) <= 2048 and max(sums) - min(sums) < 200
    assert packing.windows([]) == [] and packing.windows([2048, 2048]) == [[0], [1]]


def brute_classes(rows):
    sets, links = [], {}
    for _, text, _ in rows:
        w = ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    best = {r: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for r, m in groups.items()}
    return sorted(((rows[i][0] is None, rows[i][0] or 0), (best[root(i)] is None, best[root(i)] or 0), links.get(i, 0)) for i in range(len(rows)))


@pytest.mark.parametrize("leaf, block", [(64, 512), (2, 3)])
def test_join_matches_brute_force(spark, texts, leaf, block):
    r = random.Random(8)
    family = words(300, 9)
    rows = list(texts)
    for i in range(25):
        copy = list(family)
        for _ in range(i % 9):
            copy[r.randrange(300)] = f"new{i}"
        rows.append((100 + i, " ".join(copy), "a"))
    got = near_duplicates.classes(documents(spark, rows), leaf=leaf, block=block).collect()
    as_key = lambda v: (v is None, v or 0)
    assert sorted((as_key(x["doc_id"]), as_key(x["class_id"]), x["n_links"]) for x in got) == brute_classes(rows)


def test_one_of_each_group_stays(spark, texts):
    kept = near_duplicates.keep_one(documents(spark, texts))
    assert kept.columns == documents(spark, texts).columns
    # 2, 3 and the repeated row 1 are copies of 1, 7 of 6; the longer text of id 10 is a near copy of 1.
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "4", "5", "6", "8", "9", "10", "None", "11"])
    assert near_duplicates.keep_one(documents(spark, texts).limit(0)).count() == 0


def test_dense_overlaps_equal_sparse_ones(monkeypatch):
    import numpy as np

    sets = [np.unique(np.random.default_rng(i % 3).integers(0, 60, 40)) for i in range(12)]
    first, second = np.triu_indices(12, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(first, second)]
    monkeypatch.setattr(near_duplicates, "DENSE_CELLS", 50)
    assert near_duplicates.overlaps(sets, first, second).tolist() == want


def test_decontamination_matches_brute_force(spark, texts):
    long = words(80, 20)
    items = [(1, " ".join(long)), (2, "short item only"), (3, None), (4, " ".join(words(80, 21)[:13])), (5, " ".join(long[10:40])), (None, "the quick brown fox jumps"), (1, "second text of item one")]
    rows = list(texts) + [
        (30, "before " + " ".join(long[5:30]).upper() + " after", "a"), (31, " ".join(long[5:17]), "a"), (32, "a SHORT, item. only here", "a"), (33, "word " * 3000 + " ".join(long[:20]), "a"),
        (34, "the quick brown fox jumps", "a"),
    ]
    split = lambda t: ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for i, t, _ in rows:
        w, hit, ids = split(t), set(), set()
        for item, text in items:
            v = split(text)
            m = min(len(v), 13)
            if not m:
                continue
            own = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)}
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in own:
                    hit.update(range(k, k + m))
                    ids.add("null" if item is None else str(item))
        want.append((str(i), len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(documents(spark, rows), bench).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == sorted(want)
    assert decontamination.decontaminate(documents(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0


def test_toxicity_separates_and_scores_everything(spark, texts):
    r = random.Random(3)
    bad = "worthless pathetic disgusting".split()
    rows, labels = list(texts), []
    for i in range(400):
        w = words(80, 1000 + i)
        if i % 4 == 0:
            for _ in range(5):
                w.insert(r.randrange(80), r.choice(bad))
        rows.append((1000 + i, " ".join(w), "a"))
        labels.append((1000 + i, None, int(i % 4 == 0)))
    labels.append((1, 1, None))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    got = toxicity.score(docs, toxicity.train(docs, known)).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)
    held = [x for x in got if x["held_out"] and x["doc_id"] >= 1000]
    right = sum(x["predicted"] == int((x["doc_id"] - 1000) % 4 == 0) for x in held)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got if x["doc_id"] is not None)
    assert right / len(held) > 0.85
    assert toxicity.score(docs, toxicity.train(docs, known.limit(0))).count() == len(rows)


def test_main_text():
    page = """<html><head><title>no</title><style>p{}</style></head><body><header>top</header><nav><a href=x>menu</a></nav>
    <div class="cookie-notice">accept</div><article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>
    text<p>Second paragraph of the article, long enough to count.<br>after</p><form>sign</form><aside>side</aside>
    <script>var t = "</p>";</script><p>Short.</p><section id="comments"><p>reader says a long thing here indeed</p></section></article><footer>foot</footer>"""
    assert html_text.main_text(page) == "Head & line First bold text Second paragraph of the article, long enough to count. after Short."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>only</nav>") == ""
    body = "<body><ul class=menu>" + "<li><a href=x>go</a></li>" * 9 + "</ul>" + "<p>" + "plain long paragraph of text " * 9 + "</p>" * 1 + "<div><a>x</a></div></body>"
    assert html_text.main_text(body).startswith("plain long paragraph")


def test_toxic_windows_are_those_that_ordinary_text_does_not_explain():
    parts = toxicity.windows("worthless pathetic disgusting clown and the river ran over stones")
    plain = b" the river ran over stones "
    both, *_ = toxicity.Model(ordinary=plain + b" worthless pathetic disgusting clown ", toxic=b" worthless pathetic disgusting clown ").savings(parts)
    only, *_ = toxicity.Model(ordinary=plain, toxic=b" worthless pathetic disgusting clown ").savings(parts)
    assert both.max() < 1 and only[0] >= 6 and only[1:].max() < 1


def test_training_sample_is_whole(spark):
    texts = [f"{i} b c d e f g h" for i in range(50)]
    assert toxicity._evenly(texts, 1000) == [w for t in texts for w in toxicity.windows(t)] and toxicity._evenly([], 5) == []
    some = toxicity._evenly(texts, 25)
    assert len(some) == 25 and toxicity.windows(texts[-1])[1] in some
    docs = documents(spark, [(i, "x" * (900 if i % 2 else 9), "a") for i in range(60)] + [(0, "another text of id 0", "a")] * 300)
    known = spark.createDataFrame([(i, 0) for i in range(120)], "doc_id long, toxic int")
    assert len(toxicity.training_rows(docs, known, "toxic", 15, 1 << 20)) == 15
    bounded = toxicity.training_rows(docs, known, "toxic", 60, 2_000)
    assert sum(len(r["text"]) for r in bounded) <= 2_000 and {len(r["text"]) for r in bounded} == {9, 900}


def test_ratio_clusters_choose_lines_beside_and_inside_articles():
    story = [" ".join(words(40, 900 + i)) for i in range(4)]
    links = "".join(f"<li><a href={i}><b>{i}</b></a></li>" for i in range(9))
    card = '<article><h2>Card</h2><a href=x><b>Read</b> <i>it</i></a> <a href=y>now</a></article>'
    beside = "<body><div>" + "".join(f"<p>{p}</p>" for p in story) + f"</div><ul>{links}</ul>{card}</body>"
    assert html_text.main_text(beside).startswith(" ".join(story)) and "Read it" not in html_text.main_text(beside)
    inside = "<article><h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in story[:2]) + "<p>Yes.</p><div class=ad>buy</div>" + f"<p>{story[2]}</p><ul>{links}</ul></article>"
    assert html_text.main_text(inside).startswith(f"Title {story[0]} {story[1]} Yes. {story[2]}") and not html_text.main_text(inside).endswith("8")


@pytest.mark.parametrize("page", [
    "<body class='has-sidebar'><article>{}</article></body>", "<html class='no-banner'><body id='menu'><main class='with-sidebar'>{}</main></body></html>",
    "<body><nav>go</nav><div id='page' class='no-banner'>{}</div></body>", "<article class='post comments-open'>{}</article>",
    "<div class='post comments-open'>{}</div>", "<article><div class='entry has-sidebar'>{}</div></article>",
])
def test_names_of_containers_do_not_hide_the_page(page):
    story = [" ".join(words(30, 950 + i)) for i in range(3)]
    said = "<div id='comments'>" + "".join(f"<article class='comment'><p>{' '.join(words(40, 970 + i))}</p></article>" for i in range(6)) + "</div>"
    apart = "<div class='ad'>buy this now</div><ul class='menu'>" + "<li><a href=x>go there</a></li>" * 9 + "</ul>" + said
    inner = "<h1>Title of it</h1>" + "".join(f"<p>{p}</p>" for p in story) + apart
    assert html_text.main_text(page.format(inner)) == "Title of it " + " ".join(story)
    assert html_text.main_text("<div class='ad'>a longer text of an advert</div><article><p>A short story.</p></article>") == "A short story."


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a  b</p>", 1), (1, "u", "<p>a  b</p>", 1), (None, None, None, 2)], "page_id long, url string, html string, n_chars int")
    assert sorted((r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()) == [("", 0), ("a b", 3), ("a b", 3)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_quality_grades(spark, texts):
    rows, labels = list(texts), []
    for i in range(240):
        w, grade = words(60, 3000 + i), i % 3
        w = [x + "###" if k % 3 >= grade + (grade == 2) else x for k, x in enumerate(w)]
        rows.append((2000 + i, " ".join(w), "a"))
        labels.append((2000 + i, grade, 0))
    docs, known = documents(spark, rows), spark.createDataFrame(labels + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, known)
    assert list(model.thresholds) == sorted(model.thresholds) and model.grades == (0.0, 1.0, 2.0)
    got = {r["doc_id"]: r for r in quality_classifier.score(docs, model).collect()}
    assert len(got) == len({i for i, _, _ in rows})
    mean = [sum(got[2000 + i]["expected_grade"] for i in range(240) if i % 3 == g) / 80 for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    one = quality_classifier.train(docs, known.where("quality = 1"))
    assert quality_classifier.score(docs, one).where("kept").count() == len(rows)
    assert quality_classifier.select(docs, model).columns == docs.columns


def test_pipeline_keeps_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    rows = [(i, " ".join(words(80, 500 + i)), "en", "s", 10) for i in range(40)]
    rows += [(100 + i, "bad ### *** " * 20, "en", "s", 10) for i in range(20)] + [(200, rows[0][1], "en", "s", 10), (201, None, "en", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in rows[:60]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert {r[0] for r in out.select("doc_id").distinct().collect()} == set(range(40)) - {5}
