"""Each operator on a small table of awkward rows, against a plain version."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evimatch.llm import decontaminate, kdshards, licenses, mixing, neardup, pages, passages, quality, tokens, urlfilter

LOW = {i: i + 32 for i in range(65, 91)}
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünï", "日本", "a-b", "X."]
    out = []
    for i in range(40):
        out.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60, 120)))))
    passage = " ".join(f"p{i}" for i in range(30))
    for i in range(40, 60):
        words = out[i - 40][1].split() if i < 50 else out[0][1].split()
        words[rng.randrange(len(words))] = "changed"
        out.append((i, " ".join(words)))
    out += [(60, out[0][1]), (61, out[3][1].upper()), (62, f"x {passage} y"), (63, f"z {passage}"), (64, passage + " " + passage), (65, ""), (66, None), (67, "one"), (68, "one two three"), (69, "One two three")]
    out += [(70, "same line\n" * 60), (71, " ".join(["again"] * 3000)), (72, "\x1c\x85   Ça va <|endoftext|> 1²"), (None, out[5][1]), (5, out[5][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    return df.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b")).withColumn("lang", F.lit("en")).withColumn("n", F.lit(1)).withColumn("node", F.lit("clash"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_near_duplicates(docs, none):
    sets = {}
    for i, text in rows():
        w = SPACE.findall((text or "").translate(LOW))
        if i is not None:
            sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)
    assert neardup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("shard", [4000, 2])
def test_passages(docs, none, shard):
    first, words = {}, {}
    for i, text in sorted((r for r in rows() if r[0] is not None), key=lambda r: r[0]):
        words[i] = SPACE.findall(text or "")
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for r in passages.repeated_passages(docs, shard_segments=shard).collect():
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        w, gone = words[r.doc_id], set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < r.doc_id:
                gone.update(range(k, k + 13))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) == (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest(), left)
    assert passages.repeated_passages(none).count() == 0


@pytest.mark.parametrize("block", [200_000, 7])
def test_contamination(spark, docs, none, block):
    items = [(1, rows()[2][1]), (2, "ONE two"), (3, ""), (4, None), (2, "ONE two"), (None, "p0 p1 p2"), (11, " ".join(f"P{i}!" for i in range(4, 16)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, text in items:
        w = ALNUM.findall((text or "").translate(LOW))
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + min(10, len(w))])] |= {str(i)} if i is not None else set()
    found = decontaminate.digest(decontaminate.contamination(docs, bench, block_windows=block)).collect()
    assert len(found) == len(rows())
    for r in found:
        text = dict(rows()).get(r.doc_id)
        w, hit, found = ALNUM.findall((text or "").translate(LOW)), set(), set()
        for window, ids in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found |= ids
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    clean = decontaminate.clean(docs, bench, block_windows=block)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def test_quality(spark, docs, none):
    bad, good = "$$$ &&& junk### ", "the quick brown fox of the river "
    rng = random.Random(3)
    fresh = [(1000 + i, " ".join(rng.sample((bad if i % 2 else good).split() + [f"n{k}" for k in range(80)], 60)) + (bad if i % 2 else good) * 4) for i in range(200)]
    table = spark.createDataFrame(fresh, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in fresh[:150]] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = quality.train(table, labels)
    held = {r.doc_id: r.p_good for r in quality.quality(table, model).collect()}
    right = sum((held[i] >= 0.5) == (i % 2 == 0) for i, _ in fresh[150:])
    assert right >= 48
    got = quality.quality(docs, None).collect()
    by_id = dict(rows())
    for r in got:
        text = by_id[r.doc_id] or ""
        w, seen, again = SPACE.findall(text), set(), 0
        for line in text.split("\n"):
            if SPACE.search(line):
                again += line in seen
                seen.add(line)
        n3 = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeat = {j for k in range(len(w) - 2) if n3[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(repeat), failed, not failed)
    assert quality.quality(none, None).count() == 0 and quality.train(none, labels) is None
    assert quality.passing(docs, None).count() == sum(r.kept for r in got)


def test_tokens(docs, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.vocabulary())
    want, at = {}, 0
    for i, text in sorted((r for r in rows() if r[0] is not None), key=lambda r: (r[0], r[1] or "")):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault(i, []).append((at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    before = len(whole.encode(rows()[-2][1], add_special_tokens=False).ids) + 1
    got = tokens.read_tokens(tokens.write_tokens(docs, sequence=16, batch=4)).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is not None:
            assert (r.start - before, r.n_tokens, r.ids_crc32) in want[r.doc_id]
    assert tokens.read_tokens(tokens.write_tokens(none)).count() == 0


def test_sequences_are_found_without_a_copy(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    at = f"file://{tmp_path}/out"
    index = tokens.write_tokens(docs, path=at, sequence=16, batch=4)
    whole = Tokenizer.from_file(tokens.vocabulary())
    want = sorted(([*whole.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows()), key=len)
    got, mapped = [], {r.file for r in index.select("file").distinct().collect()}
    for path in mapped:
        f, ids = tokens.SequenceFile(path), []
        f.map.seek(0)
        base = f.map.read_buffer(f.map.size())
        i = 0
        while True:
            try:
                own, mask = f.sequence(i)
            except IndexError:
                break
            assert base.address <= own.ctypes.data < base.address + base.size and base.address <= mask.buffers()[1].address < base.address + base.size
            assert len(own) == len(mask) == 16
            ids += [x for x, m in zip(own.tolist(), mask.to_pylist(), strict=True) if m]
            i += 1
        assert f.sequence(i - 1)[0].tolist() == own.tolist() and i > 1
        with pytest.raises(IndexError):
            f.sequence(-1)
        for r in index.where(F.col("file") == path).collect():
            got.append(ids[r.at : r.at + r.n_tokens])
    assert sorted(got, key=lambda x: (len(x), x)) == sorted(want, key=lambda x: (len(x), x))
    assert spark.read.parquet(f"{at}/index").count() == len(rows())


def test_tokens_keep_the_order_of_a_written_table(spark, tmp_path):
    lengths = [5, 900, 40, 3000, 1]  # files of different sizes, which Spark reads in another order
    for k, n in enumerate(lengths):
        frame = spark.createDataFrame([(1000 * k + i, " ".join(f"w{j}" for j in range(n))) for i in range(3)], "doc_id long, text string").coalesce(1)
        frame.write.mode("append").parquet(f"{tmp_path}/{k}")
        for f in (tmp_path / str(k)).glob("*.parquet"):
            (tmp_path / "all").mkdir(exist_ok=True)
            f.rename(tmp_path / "all" / f"part-{k:05d}.parquet")
    stored = spark.read.parquet(f"{tmp_path}/all")
    got = tokens.read_tokens(tokens.write_tokens(stored, order=tokens.as_stored(stored))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [1000 * k + i for k in range(5) for i in range(3)]
    made = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert tokens.read_tokens(tokens.write_tokens(made, order=tokens.as_stored(made))).count() == 2


def test_encoder_equals_the_library():
    e, rng = tokens.Encoder(tokens.vocabulary(), "uint16"), random.Random(2)
    parts = [*"abcXYZ019 \t\n'.,!-éÉßµªº²×ÿŒΣς日́ \x1c\x85|<>", "'ll", "'VE", "<|endoftext|>", "<|startoftext|>", "\U0001f600"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(24)))
        assert np.frombuffer(e.encode([s.encode()])[0], dtype="uint16").tolist() == e.tokenizer.encode(s, add_special_tokens=False).ids


def test_mixing(docs, none):
    got = mixing.mix(docs, {"a": 3.0, "b": 1.0})
    assert got.columns == [*docs.columns, "copy_no", "mix_key"]
    assert sorted(got.select("doc_id", "copy_no", "mix_key").collect()) == sorted(mixing.mix(docs.repartition(5), {"a": 3.0, "b": 1.0}).select("doc_id", "copy_no", "mix_key").collect())
    assert {r.source for r in got.select("source").distinct().collect()} <= {"a", "b"}
    rate = {r.source: r.rate * r.bytes for r in mixing.rates(docs, {"a": 3.0, "b": 1.0}).collect()}
    assert abs(rate["a"] / rate["b"] - 3) < 1e-9
    assert mixing.mix(none).count() == 0


def test_poisson_draws(spark):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.lit("s").alias("source"))
    counts = collections.Counter(r.doc_id for r in mixing.mix(many, epochs=2.0).select("doc_id").collect())
    n = [counts[i] for i in range(20_000)]
    assert abs(np.mean(n) - 2) < 0.05 and abs(np.var(n) - 2) < 0.12


def test_shards(docs, none):
    got = kdshards.kd_shards(docs, 8).collect()
    assert len(got) == len(rows())
    slots = collections.defaultdict(list)
    for r in got:
        text = (dict(rows()).get(r.doc_id) or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "bytes", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(8))
    assert kdshards.kd_shards(none, 8).count() == 0


def test_shards_are_even(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("concat(string(id), repeat('x', cast(id % 46 as int)))").alias("text"), F.expr("if(id % 3 = 0, 'hot', string(id % 7))").alias("source"), F.lit(None).cast("string").alias("lang"))
    sizes = [r.b for r in kdshards.kd_shards(many, 5).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 4 * 50


@pytest.mark.parametrize("hot_from", [10_000, 3])
def test_equal_texts_share_a_shard(spark, monkeypatch, hot_from):
    monkeypatch.setattr(kdshards, "HOT_ROWS", hot_from)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdef") * rng.randrange(1, 9) for _ in range(20)) for _ in range(1500)]
    rows_of = [(i, texts[i % 1500] if i < 6000 else "the same text again", f"s{rng.randrange(4)}") for i in range(9000)]
    frame = spark.createDataFrame(rows_of, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    got = kdshards.kd_shards(frame, 4).collect()
    where, sizes = collections.defaultdict(set), collections.Counter()
    for r in got:
        where[rows_of[r.doc_id][1]].add(r.shard)
        sizes[r.shard] += r.size
    share = sum(sizes.values()) / 4
    assert len(got) == 9000 and len(sizes) == 4
    assert all(len(v) == 1 for v in where.values())
    assert max(sizes.values()) - min(sizes.values()) <= share * 6 / kdshards.LARGE_PART


def test_only_groups_larger_than_a_shard_are_cut(spark):
    frame = spark.range(6000).selectExpr("id as doc_id", "if(id < 3000, repeat('a', 60), if(id < 4400, repeat('b', 60), concat(repeat('c', 55), string(id)))) as text", "'s' as source", "'en' as lang")
    got = kdshards.kd_shards(frame, 4).collect()
    where, sizes = collections.defaultdict(set), collections.Counter()
    for r in got:
        where["a" if r.doc_id < 3000 else "b" if r.doc_id < 4400 else "c"].add(r.shard)
        sizes[r.shard] += r.size
    assert len(got) == 6000 and len(where["a"]) > 1 and len(where["b"]) == 1  # b nearly fills a shard
    assert max(sizes.values()) - min(sizes.values()) <= 200


def test_shards_like_a_plain_tree(spark):
    rng = random.Random(8)
    points = [(i, f"{i} " + "x" * int(rng.expovariate(0.02)), rng.choice(["a", "b", "c", None]), rng.choice(["en", "de"])) for i in rng.sample(range(9000), 700)]
    code = lambda x: -1 if x is None else zlib.crc32(x.encode())
    told = [(len(t) + 1, code(s), code(g), i) for i, t, s, g in points]
    span = [max(1.0, float(max(p[d] for p in told) - min(p[d] for p in told))) for d in range(4)]

    def grow(own, first, n):
        if n < 2 or not own:
            return {p[3]: first for p in own}
        widths = [(max(p[d] for p in own) - min(p[d] for p in own)) / span[d] for d in range(4)]
        dim = widths.index(max(widths))
        ordered, so_far, want = sorted(own, key=lambda p: (p[dim], p[3])), 0, sum(p[0] for p in own) * (n // 2) / n
        for k, p in enumerate(ordered, 1):
            so_far += p[0]
            if so_far >= want:
                break
        return grow(ordered[:k], first, n // 2) | grow(ordered[k:], first + n // 2, n - n // 2)

    frame = spark.createDataFrame(points, "doc_id long, text string, source string, lang string")
    for n in (3, 8):
        assert {r.doc_id: r.shard for r in kdshards.kd_shards(frame, n).collect()} == grow(told, 0, n)


def test_url_lists(spark):
    entries = spark.createDataFrame([("domain", "bad.org", "add", "2024-02-01"), ("domain", "bad.org", "remove", "2024-03-01"), ("prefix", "ok.org/ads/", "add", "2024-01-01"), ("host", None, "add", "2024-01-01")], "kind string, pattern string, action string, at string")
    seen = [(1, "http://x.bad.org/a", "2024-02-10"), (2, "http://x.bad.org/a", "2024-03-01"), (3, "https://u@OK.org:80/ads/1?x", "2024-05-01"), (4, "https://ok.org/adsense", "2024-05-01"), (5, None, "2024-05-01"), (6, "http://notbad.org/", "2024-02-10"), (7, "http://bad.org", None)]
    got = urlfilter.judge(spark.createDataFrame(seen, "page_id long, url string, fetched_at string"), entries)
    assert {r.page_id: r.matched for r in got.collect()} == {1: "domain:bad.org", 2: "", 3: "prefix:ok.org/ads", 4: "", 5: "", 6: "", 7: ""}


def test_licenses(spark, docs, none):
    texts = [(1, "x y z Licensed under the Apache License, Version 2.0. more"), (2, "this work is LICENSED under\nthe GNU General Public License, version 3"), (3, "no licence here"), (4, "Licensed under CC BY-NC 4.0."), (5, None), (6, licenses.TEMPLATES["mit-grant"].replace("copy", "duplicate"))]
    got = {(r.doc_id, r.template_id) for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {(1, "apache-2.0-notice"), (2, "gpl-3.0-notice"), (4, "cc-by-nc-4.0-notice")} <= got
    assert not {i for i, _ in got} & {3, 5}
    assert licenses.scan(none).count() == 0


def test_licences_that_differ_in_a_word(spark):
    full = licenses.TEMPLATES
    texts = {1: "Code: " + full["gpl-3.0-notice"], 2: full["gpl-2.0-notice"], 3: "x " * 40 + full["gpl-3.0-header"] + " y" * 30, 4: full["gpl-2.0-header"].replace("hope", "belief"), 5: "(c) 2020 Somebody. ALL RIGHTS RESERVED", 6: full["mit-text"], 7: full["bsd-2-clause-text"], 8: "General Public License version 3 or 2"}
    got = {(r.doc_id, r.template_id) for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = {(1, "gpl-3.0-notice"), (2, "gpl-2.0-notice"), (3, "gpl-3.0-header"), (4, "gpl-2.0-header"), (5, "all-rights-reserved"), (6, "mit-grant"), (6, "mit-text"), (7, "bsd-redistribution"), (7, "bsd-2-clause-text")}
    assert got == want
    assert licenses.deciding(full)["gpl-2.0-notice"] == ["general public license version 2"] and licenses.deciding(full)["mit-notice"] == []


def test_pages(spark):
    site = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a>menu</a></nav><div class='zone'>same everywhere</div>{}<div class='ad'>buy {}</div><footer>&copy;</footer></body></html>"
    bodies = ["<article><h1>A &amp; B</h1><p>one<b> two\n three<p>four<form>x</form></article>", "<div><p>plain {}</p><section id=comments>hi</section></div>"]
    data = [(i, f"http://h.org/{i}", site.format(bodies[i % 2].replace("{}", str(i)), i)) for i in range(20)] + [(90, None, None), (91, "bad", ""), (92, "http://h.org", "<p>loose < text")]
    got = {r.page_id: r for r in pages.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[0].text == "A & B\none two three\nfour" and got[3].text == "plain 3" and got[0].n_chars == len(got[0].text)
    assert (got[90].text, got[91].text, got[92].text) == ("", "", "loose < text")


def test_site_frames_go_without_any_word_of_a_list(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    page = lambda body: f"<html><body><div class='q1'><span>{say(2)}</span><span>{say(2)}</span></div><div class='q2'>{say(9)}</div>{body}<div class='q3'>{say(4)}</div></body></html>"
    data, want = [], {}
    for i in range(30):
        paragraphs = [say(rng.randrange(20, 40)) for _ in range(rng.randrange(1, 4))]
        want[i] = "\n".join(paragraphs)
        data.append((i, "http://one.org/x", page("<div class='z'>" + "".join(f"<p>{x}</p>" for x in paragraphs) + "</div>"), 1, "clash"))
    data.append((99, "http://two.org/", "<div class='q2'>alone</div>", 1, "clash"))
    frame = spark.createDataFrame(data + data[:1], "page_id int, url string, html string, host int, templates string")
    got = pages.extract(frame).collect()
    assert len(got) == len(data) + 1 and all(r.text == want.get(r.page_id, "alone") for r in got)
    alone = pages.extract(frame, min_pages=1000).collect()
    assert sum(r.text != want.get(r.page_id, "alone") for r in alone) == 31
    assert pages.extract(frame.limit(0)).count() == 0


def test_hostile_pages_are_parsed_in_linear_time():
    import time

    for piece in ('<a "', "<a '\"", "<!--", "</script", "<script>", "<b>", "<b></i>", "<li>", "<p", '<x y="'):
        text = piece * (400_000 // len(piece)) + ">"
        t = time.time()
        pages.main_text(pages.parse(text), set())
        assert time.time() - t < 20, piece


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50


def test_any_number_of_shards(spark):
    many = spark.range(64).select(F.col("id").alias("doc_id"), F.lit("xxx").alias("text"), F.lit("hot").alias("source"), F.lit("en").alias("lang"))
    got = [r.shard for r in kdshards.kd_shards(many, 100_000).collect()]
    assert len(got) == len(set(got)) == 64 and 0 <= min(got) and max(got) < 100_000
    assert kdshards.kd_shards(many, target_bytes=64).select("shard").distinct().count() == 4
