"""The ten operators against brute force on a small table with every odd case."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
import xxhash
import pytest
from pyspark.sql import functions as F

from lodestone.llm import attention, decontaminate, gam, hashing, lines, merkle, minhash, pieces, substrings, token_files, tokenizers_at, warc
from lodestone.llm.components import components
from lodestone.llm.tables import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, bucket string, row string, doc string"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def texts():
    rng = np.random.default_rng(5)
    vocabulary = ["the", "of", "Éa", "x|y", "naïve", *(f"w{k}" for k in range(400))]
    out = {}
    for k in range(60):
        words = rng.choice(vocabulary, rng.integers(5, 120)).tolist()
        out[k] = "".join(w + rng.choice([" ", " ", " ", "\n", ". ", "  "]) for w in words)
    out[60] = out[3]
    out[61] = out[3].replace("w1", "W1")
    out[62] = out[3] + " tail end"
    out[63] = out[10][: len(out[10]) // 2] + " " + out[20]
    out[64] = None
    out[65] = ""
    out[66] = " \n\t "
    out[67] = "one"
    out[68] = "z" * 30_000 + " " + out[7]
    out[69] = " ".join(out[k] for k in range(20))
    out[70] = "one"
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", 1, "a", "b", "c", "d") for k, t in texts().items()] + [(None, texts()[3], None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def known():
    return {**texts(), None: texts()[3]}


def last(k):
    return math.inf if k is None else k


def test_word_hashes_tell_words_apart():
    column = pa.array([None, "a  b c", "", "A b", "ab " * 3, "x" * 200_000 + " y"])
    w = hashing.words_of(column, lower=True)
    assert np.diff(w.first).tolist() == [0, 2, 0, 2, 3, 2]
    assert w.hash[0] == w.hash[2] and len(set(w.hash[4:7].tolist())) == 1 and len(set(w.hash.tolist())) == 6


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000])
def test_elias_fano_selects(n):
    numbers = np.cumsum(np.random.default_rng(n).integers(0, 900, n))
    code = token_files.EliasFano.from_bytes(token_files.EliasFano.of(numbers).to_bytes())
    assert numbers.tolist() == [code.select(k) for k in range(n)]
    if n == 1000:
        assert len(code.to_bytes()) < n * 2
        with pytest.raises(IndexError):
            code.select(n)


def test_token_files_hold_every_id(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizers_at("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    start, want = 0, []
    for k, t in sorted(known().items(), key=lambda x: last(x[0])):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    got = sorted(map(tuple, token_files.token_file(docs, path, with_ids=True).collect()), key=lambda x: last(x[0]))
    assert got == [(*x[:4], bytearray(x[4])) for x in want]
    assert token_files.token_file(empty, path).count() == 0


def test_chunks_encode_as_whole_texts():
    path = tokenizers_at("byte_bpe_50k.json")
    odd = ["a  b", "a \u3000\n b", "  x", "x  ", "don't  stop", "\n\n a\tb\r\n", "\x0bx", "<|endoftext|> y", "é 12 3!!  ?", None, "", "<|endof", "x<|endoftext|>", "a\u2003b", "“x” – y…", " ", "b a"]
    rng = np.random.default_rng(3)
    odd += ["".join(rng.choice(list("ab <|>.'s\n\t\u00a0é“"), 40)) for _ in range(300)]
    for at_once in (odd, odd[::-1], odd[:1]):
        encoder = token_files.Encoder(path)
        ids, counts = encoder.encode(pa.array(at_once, pa.string()))
        want = [encoder.tokenizer.encode(x or "", add_special_tokens=False).ids for x in at_once]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]
    assert encoder.tokenizer.encode("<|endoftext|>").ids == [50256]  # a special token in a text is one


def test_token_files_of_many_shards_start_where_the_last_one_ends(spark):
    docs = spark.range(3000).selectExpr("id * 7 - 500 AS doc_id", "repeat(concat('w', id % 91, ' '), id % 40) AS text").repartition(5)
    path = new_path(spark, "shards")
    token_files.write_tokens(docs, path, tokenizers_at("byte_bpe_50k.json"), shard_bytes=1000)
    rows = sorted(token_files.read_tokens(spark, path, with_ids=False).collect())
    assert spark.read.parquet(path).count() > 1 and len(rows) == 3000
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens


def test_archive_gives_every_record_again(spark):
    pages = [(1, "u", "same"), (5, "v", "same"), (3, "w\r\nx", "same"), (7, "y", None), (8, None, ""), (None, "n", "same"), (9, "z", "é" * 50), (-4, "m", "own")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha256", F.lit("clash"))
    path = new_path(spark, "test")
    warc.write_archive(table, path, min_bytes=0)
    best = {}
    for k, _, h in pages:
        best[h or ""] = max(best.get(h or "", -math.inf), -math.inf if k is None else k)
    got = {r.page_id: r for r in warc.read_records(spark, path).collect()}
    index = {r.page_id: r for r in warc.read_index(spark, path).collect()}
    assert len(got) == len(pages)
    for k, _, h in pages:
        raw, keeper = (h or "").encode(), best[h or ""]
        assert bytes(got[k].payload) == raw and index[k].payload_bytes == len(raw)
        assert index[k].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (index[k].record_type, index[k].refers_to) == (("response", None) if k == keeper else ("revisit", keeper))
        record = bytes(got[k].record)
        head, block = record.split(b"\r\n\r\n", 1)
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert block[length:] == b"\r\n\r\n" and (block[:length].split(b"\r\n\r\n", 1)[-1] == raw if k == keeper else not length)
    assert b"WARC-Target-URI: w%0D%0Ax\r\n" in bytes(got[3].header)
    assert spark.read.parquet(f"{path}/payloads").count() == len(best)
    assert {r.record_type for r in warc.archived(table, min_bytes=1000).collect()} == {"response"}
    assert warc.archived(table.limit(0)).count() == 0


def test_archive_refuses_a_block_of_another_length(spark):
    path, other = new_path(spark, "test"), new_path(spark, "test")
    warc.write_archive(spark.createDataFrame([(1, "u", "some text")], "page_id long, url string, html string"), path)
    records = spark.read.parquet(f"{path}/records")
    records.withColumn("header", F.encode(F.regexp_replace(F.decode("header", "UTF-8"), "Content-Length: 6", "Content-Length: 7"), "UTF-8")).write.parquet(f"{other}/records")
    spark.read.parquet(f"{path}/payloads").write.parquet(f"{other}/payloads")
    assert len(warc.read_index(spark, path).collect()) == 1
    with pytest.raises(Exception, match="another length"):
        warc.read_index(spark, other).collect()


def shingles(text, n):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_lose_no_link(spark, docs, empty, n):
    rng = np.random.default_rng(1)
    base = [f"b{k}" for k in range(150)]
    more = {}
    for k in range(120):  # a family of edited copies, many too far from each other
        words = list(base)
        for p in rng.choice(150, rng.integers(0, 12), False):
            words[p] = f"e{rng.integers(0, 9)}"
        more[1000 + k] = " ".join(words)
    rows = [(k, t) for k, t in {**known(), **more}.items()]
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=n).collect()}
    sets = {k: shingles(t, n) for k, t in rows}
    comp = {k: k for k in sets}

    def find(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a, b in itertools.combinations(sorted(sets, key=last), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 80 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)), key=last)
            comp[b] = a
    for k in sets:
        want = find(k)
        assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (len(sets[k]), want, k == want), k
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_pair_few_rows_of_a_template(spark, monkeypatch):
    """Documents that share a template, none near copies: cells that can't hold similar sets never meet."""
    rng = np.random.default_rng(3)
    body = [f"t{k}" for k in range(170)]
    rows = [(k, " ".join([*body, *(f"w{rng.integers(0, 4000)}x" for _ in range(30))])) for k in range(400)]
    met = []
    unmet = minhash._Tests.unmet

    def counted(self, labels):
        cells = minhash._cells
        monkeypatch.setattr(minhash, "_cells", lambda rare, percent: met.append(cells(rare, percent).count()) or cells(rare, percent))
        return unmet(self, labels)

    monkeypatch.setattr(minhash._Tests, "unmet", counted)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got) and len(got) == 400
    assert met == [0]


@pytest.mark.parametrize("percent", [80, 60])
def test_cells_hold_every_pair_that_can_be_similar(spark, percent):
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 400, 300)
    rows = [(0, k, int(n), int(np.ceil(n * rng.uniform(percent / 100, 1)))) for k, n in enumerate(sizes)]
    rows = [(s, c, n, min(n, r), int(math.log(n) / math.log(minhash._SIZES)), minhash._REACHES * min(n, r) // n) for s, c, n, r in rows]
    table = spark.createDataFrame(rows, "shingle long, c long, size long, reach long, sizes long, reaches long")
    cells = {tuple(r)[1:] for r in minhash._cells(table, percent).collect()}
    for (_, _, m, p, *x), (_, _, n, q, *y) in itertools.product(rows, rows):
        shared = min(p, q)
        if 100 * shared >= percent * (m + n - shared):
            assert (*x, *y) in cells


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.comp for r in components(links).collect()} == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_patience_aligns_in_order():
    assert lines.patience(list("abcde"), list("xbcye")) == [(1, 1), (2, 2), (4, 4)]
    assert lines.patience(list("aab"), list("ab")) in ([(0, 0), (2, 1)], [(1, 0), (2, 1)])
    assert lines.patience([], list("a")) == []
    rng = np.random.default_rng(2)
    for _ in range(100):
        a, b = rng.integers(0, 8, 20).tolist(), rng.integers(0, 8, 20).tolist()
        pairs = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(pairs))


def test_line_dedup_deletes_common_blocks_from_the_later(spark, empty):
    a, b, c = (f"{x} is a line of some length, number {x}" for x in "abc")
    rows = [(1, f"{a}\n\n{b}"), (2, f"own line of the second one\n{a}\n\n{b}\nend"), (3, f"{b}\n{a}"), (4, f"short\n{c}"), (5, f"short\n{c}"), (6, None), (7, ""), (None, c), (8, "short")]
    table = spark.createDataFrame([(k, t, "n", 1) for k, t in rows], "doc_id long, text string, n_lines string, row int")
    got = {r.doc_id: r for r in lines.dedup_lines(table).collect()}
    left = {k: r.text for k, r in got.items()}
    assert left[1] == rows[0][1] and left[2] == "own line of the second one\nend" and left[3] in (a, b, "")
    assert (left[4], left[5], left[6], left[7], left[None], left[8]) == (f"short\n{c}", "", None, "", "", "short")
    assert got[2].n_removed == 3 and got[2].row == 1
    assert lines.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_patience_takes_longest_chains(seed):
    """Pairs are of equal lines in order; lines found once in both align in as long a chain as there is."""
    rng = np.random.default_rng(seed)
    a, b = (rng.permutation(9)[: rng.integers(4, 10)].tolist() for _ in "ab")
    pairs = lines.patience(a, b)
    assert all(a[i] == b[k] for i, k in pairs) and all(x < y and z < w for (x, z), (y, w) in itertools.pairwise(pairs))
    common = [x for x in a if x in b]
    best = max(n for n in range(len(common) + 1) for c in itertools.combinations(common, n) if [b.index(x) for x in c] == sorted(b.index(x) for x in c))
    assert len(pairs) == best
    assert lines.patience([1, 1, 2, 1], [1, 1, 2, 1]) == [(k, k) for k in range(4)] and lines.patience([], [1]) == []


def test_line_dedup_equals_owners_found_in_plain_dictionaries(spark):
    """Owners, rarest parts and the order of partners by dictionaries over all documents; repeated and short lines."""
    rng = np.random.default_rng(12)
    pool = [f"a long enough line with number {k}" for k in range(40)] + ["", "short", "x"]
    texts = {k * 3: "\n".join(rng.choice(pool, rng.integers(0, 12))) for k in range(70)}
    texts[211], texts[212] = texts[30], texts[30] + "\n" + pool[0]
    parts = {}
    for k, t in texts.items():
        own = [x.strip() for x in lines.split_lines(t)]
        long = [len(x) >= 20 for x in own]
        parts[k] = {("line", x) for x, y in zip(own, long, strict=True) if y} | {("pair", x, z) for (x, y), (z, w) in itertools.pairwise(zip(own, long, strict=True)) if y or w} | ({("all", *own)} if any(long) else set())
    holders = collections.defaultdict(list)
    for k in sorted(parts):
        for x in parts[k]:
            holders[x].append(k)
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()}
    for k, t in texts.items():
        rarest = {}
        for x in parts[k]:
            if (owner := holders[x][0]) < k:
                rarest[owner] = min(rarest.get(owner, math.inf), len(holders[x]))
        own = [x.strip() for x in lines.split_lines(t)]
        number = {x: n for n, x in enumerate(pool)}
        gone = lines.aligned(np.array([number[x] for x in own]), np.array([len(x) >= 20 for x in own], bool), [np.array([number[x.strip()] for x in lines.split_lines(texts[o])]) for _, o in sorted((n, o) for o, n in rarest.items())])
        assert got[k].text == "\n".join(x for x, y in zip(lines.split_lines(t), gone, strict=True) if not y) and got[k].n_removed == gone.sum()


def test_copies_of_documents_that_own_no_line_go(spark):
    x, y, once, other, more = (f"the long line that is called {k}" for k in ("x", "y", "once", "other", "more"))
    rows = [(1, f"{x}\n{other}\n{y}"), (2, f"{y}\n{x}"), (3, f"{y}\n{x}"), (4, f"own words of four\n{once}\n{more}"), (5, f"{once}\n\n{once}"), (6, f"{once}\n\n{once}"), (7, f"a line of its own in seven\n{y}\n{x}")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text for r in lines.dedup_lines(table).collect()}
    assert left[1] == rows[0][1] and left[2] in (x, y) and left[5] == rows[4][1]
    assert (left[3], left[6], left[7]) == ("", "", "a line of its own in seven")


def test_language_scores_count_every_token(docs, empty):
    model = tokenizers_at("piece_bpe_32k.model")
    got = {r.doc_id: r for r in attention.language_scores(docs, model).collect()}
    tokens = {k: [*WORD.findall(lower(t or "")), "\0"] for k, t in known().items()}
    held = {k: zlib.crc32(b"" if k is None else str(k).encode()) % 5 == 1 for k in tokens}
    counts = collections.Counter(x for k, w in tokens.items() if not held[k] for x in w)
    n, v = sum(counts.values()), len(counts)
    for k, w in tokens.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.score < 0 and math.isfinite(r.score)
    assert attention.language_scores(empty, model).count() == 0


def test_word_probabilities_sum_to_at_most_one(docs):
    """Of all words of up to two subwords out of a few, and of the end, after a start of text."""
    model = tokenizers_at("piece_bpe_32k.model")
    subwords = attention.Subwords.get(model)
    texts = [x for x, _ in subwords.of([t for t in known().values() if t])]
    counts = np.bincount(np.concatenate(texts), minlength=subwords.size + 1).astype(float)
    counts[-1] = len(texts)
    rng = np.random.default_rng(1)
    used = np.flatnonzero(counts[:-1])
    classes = np.append(np.where(subwords.starts, 1 + rng.integers(0, attention.STARTS, subwords.size), 1 + attention.STARTS + rng.integers(0, attention.INSIDES, subwords.size)), 0)
    counts[np.setdiff1d(np.arange(subwords.size), used)] = -0.0999999  # what was never seen has next to no share
    network = attention.Network(counts, classes, rng)
    network.train(texts[:20], rng, steps=30)
    words = [[k] for k in used if subwords.starts[k]]
    insides = [k for k in used if not subwords.starts[k]]
    words += [[a[0], b] for a in words for b in insides[:40]]
    logp, begin = network.score([np.array(x, np.int32) for x in words])
    at = np.cumsum([0, *(len(x) + 1 for x in words)])
    by_parts = np.add.reduceat(logp, at[:-1]) - logp[at[1:] - 1] + begin[at[1:] - 1]  # its subwords, and then a begin
    by_parts -= begin[at[:-1]]
    end = network.score([np.zeros(0, np.int32)])
    known_of = rng.integers(0, 9, len(words))
    scorer = attention._Scorer(network, 8, int(known_of.sum()) + 7, 1, 7)
    total = sum(np.exp(scorer.mixed(known_of, by_parts.astype(float), s)).sum() + np.exp(scorer.mixed(np.array([7]), (end[0] - end[1]).astype(float), s))[0] for s in (0.3,))
    assert 0.5 < total <= 1.001


def test_network_learns_from_every_training_document(spark, docs):
    model = tokenizers_at("piece_bpe_32k.model")
    subwords = attention.Subwords.get(model)
    texts = [subwords.of([t])[0][0] for k, t in known().items() if not attention.held_out(k)]
    encoded = docs.select("doc_id", "text").mapInArrow(attention._encoder(model), attention._BATCH_DDL)
    counts = np.bincount(np.concatenate(texts), minlength=subwords.size + 1).astype(float)
    mark = attention._marks(counts, subwords.size)
    want = np.zeros((subwords.size, 2 * attention.MARKS))
    for a, b in (z for x in texts for z in itertools.pairwise(x.tolist())):
        if mark[b] >= 0:
            want[a, mark[b]] += 1
        if mark[a] >= 0:
            want[b, mark[a] + attention.MARKS] += 1
    seen = attention._neighbours(encoded, mark)
    assert (seen == want).all()
    rng = np.random.default_rng(1)
    network = attention.Network(counts, attention._classes(seen, counts, subwords.starts, rng), rng)
    rows, targets, scored, _ = network.windows(texts)
    loss = lambda: network.step(rows, network.classes[targets], scored.astype(np.float32))[0]
    before = loss()
    assert attention._trained(encoded, network) == sum(len(x) + 1 for x in texts)
    assert loss() < before


def test_each_subword_is_scored_once_and_only_from_before():
    rng = np.random.default_rng(0)
    counts, classes = np.ones(51), np.append(1 + rng.integers(0, attention.STARTS + attention.INSIDES, 50), 0)
    net = attention.Network(counts, classes, rng)
    text = [rng.integers(0, 50, n).astype(np.int32) for n in (0, 1, 31, 32, 90)]
    _, _, scored, place = net.windows(text)
    assert sorted(place[scored].tolist()) == list(range(sum(len(x) + 1 for x in text)))
    logp, _ = net.score(text)
    changed = [*text[:-1], np.append(text[-1][:-1], (text[-1][-1] + 1) % 50).astype(np.int32)]
    assert np.allclose(net.score(changed)[0][:-2], logp[:-2])
    total = sum(np.exp(net.score([np.array([k], np.int32)])[0][0]) for k in range(50)) + np.exp(net.score([np.zeros(0, np.int32)])[0][0])
    assert total == pytest.approx(1, abs=1e-3)


def test_subwords_of_words_met_before_are_not_encoded_again(monkeypatch):
    model, asked = tokenizers_at("piece_bpe_32k.model"), []

    class Counted:
        def __init__(self, sp):
            self.sp = sp

        def encode(self, words, **how):
            asked.extend(words)
            return self.sp.encode(words, **how)

    texts = [["one two three", "two  Zwei \u00e9t\u00e9 \ufffd"], ["three four two", None, ""], ["", None], ["\u00e9t\u00e9 five one six seven", "one"]]
    for most, again in ((1 << 19, 0), (5, 3)):
        monkeypatch.setattr(attention, "MET", most)
        kept = attention.Subwords(model)
        kept.sp, asked[:] = Counted(kept.sp), []
        for batch in texts:
            w = hashing.words_of(pa.array(batch, pa.string()), lower=True)
            got, want = kept.distinct(w), attention.Subwords(model).distinct(w)
            assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
        assert len(asked) - len(set(asked)) <= again and (most < 10 or len(asked) == 10)


def test_mixtures_are_sums_of_mixed_tokens():
    rng = np.random.default_rng(6)
    known, by_parts = np.append(rng.integers(0, 50, 2000), [0, 1, 10**6]), np.append(-rng.exponential(9, 2000), [-800.0, -900.0, -950.0])
    scorer = attention._Scorer(None, 8, 2 * 10**6, 100, 7)
    for less in (0, 1):
        want = [scorer.mixed(known, by_parts, x, less).sum() for x in attention._SHARES]
        assert np.allclose(scorer.mixtures(known, by_parts, attention._SHARES, less), want, rtol=1e-12)
    assert scorer.mixtures(known[:0], by_parts[:0], (0.5,)) == [0.0]


def test_attention_gradients():
    rng = np.random.default_rng(3)
    net = attention.Network(np.ones(21), np.append(1 + rng.integers(0, 39, 20), 0), rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows, targets = rng.integers(0, 20, (2, attention.WINDOW)), net.classes[rng.integers(0, 20, (2, attention.WINDOW))]
    weight = np.ones(targets.shape)
    _, grad = net.step(rows, targets, weight)
    for name in ("q", "k", "v", "o", "out", "places"):
        at = tuple(0 for _ in net.p[name].shape)
        kept, h = net.p[name][at], 1e-5
        net.p[name][at] = kept + h
        up, _ = net.step(rows, targets, weight)
        net.p[name][at] = kept - h
        down, _ = net.step(rows, targets, weight)
        net.p[name][at] = kept
        assert grad[name][at] == pytest.approx((up - down) / (2 * h), rel=2e-3, abs=1e-7)


def tree(text):
    """Root, and sections as (digest, paragraphs as (digest, phrase marks))."""
    sections, closed = [[[], []]], True
    for line in text.split("\n"):
        if not closed:
            sections.append([[], []])
        digest = hashlib.sha256(line.encode()).hexdigest()
        marks = tuple(f"{xxhash.xxh64_intdigest(x.encode(), 42) & 0xFFFF:04x}" for x in regex.split(r"\s+(?=[aehorAEHOR]|[^\u0000-\u024F\s])", line))
        sections[-1][0].append(digest)
        sections[-1][1].append((digest[:8], marks))
        closed = digest[-1] not in "01"
    digests = [hashlib.sha256("".join(x).encode()).hexdigest() for x, _ in sections]
    if not closed:
        digests.append(hashlib.sha256(b"").hexdigest())
        sections.append([[], []])
    return hashlib.sha256("".join(digests).encode()).hexdigest(), [(d[:8], tuple(p)) for d, (_, p) in zip(digests, sections, strict=True)]


def tree_likeness(a, b):
    (root_a, a), (root_b, b) = tree(a), tree(b)
    if root_a == root_b:
        return 1.0
    a, b = set(a), set(b)
    pa, pb = ({p for _, ps in x - y for p in ps} for x, y in ((a, b), (b, a)))
    same = sum(len(p[1]) for _, ps in a & b for p in ps) + sum(len(p[1]) for p in pa & pb)
    fa, fb = ({m for p in x - y for m in p[1]} for x, y in ((pa, pb), (pb, pa)))
    return 2 * (same + len(fa & fb)) / (2 * same + len(fa) + len(fb))


def test_fingerprints_of_edited_texts(docs, empty):
    got = {r.doc_id: r for r in merkle.fingerprints(docs).collect()}
    order = sorted(known().items(), key=lambda x: last(x[0]))
    for n, (k, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k].near_edited == pytest.approx(tree_likeness(t, edited)) and got[k].near_next == pytest.approx(tree_likeness(t, after))
        mine, theirs = tree(t)[1], set(tree(edited)[1])
        assert got[k].first_edit == next((n for n, x in enumerate(mine) if x not in theirs), None)
        assert got[k].fingerprint == tree(t)[0] + "".join(f";{d}" + "".join(f",{p}" + "".join(m) for p, m in ps) for d, ps in mine)
    prints = collections.defaultdict(set)
    for k, t in order:
        prints[t or ""].add(got[k].fingerprint)
    assert all(len(x) == 1 for x in prints.values()) and len({min(x) for x in prints.values()}) == len(prints)
    assert np.mean([r.near_edited for r in got.values()]) > 0.6
    long = [k for k, t in known().items() if len(t or "") > 1000]
    assert sum(len(got[k].fingerprint) for k in long) < 0.5 * sum(got[k].n_chars for k in long)
    assert merkle.fingerprints(empty).count() == 0


def test_next_documents_over_many_buckets(spark):
    table = spark.createDataFrame([(k * 3, str(k)) for k in range(300)] + [(None, "null")], "doc_id long, text string").repartition(5)
    rows = merkle.with_next(table, ["text"], rows_a_bucket=20).withColumn("next", F.lead("text").over(merkle.following())).where("NOT guest")
    got = {r.text: r.next for r in rows.collect()}
    assert got == {**{str(k): str(k + 1) for k in range(299)}, "299": "null", "null": "0"}


def test_differing_branches(spark):
    a, b = "one paragraph here\nanother one there\nand a third", "one paragraph here\nanother changed there\nand a third"
    row = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.differing(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("d")).first()
    sections = tree(a)[1]
    at = [(k, [n for n, p in enumerate(s[1]) if p[0] == hashlib.sha256(b"another one there").hexdigest()[:8]]) for k, s in enumerate(sections)]
    assert [(s.position, s.digest, s.paragraphs) for s in row.d] == [(k, sections[k][0], x) for k, x in at if x]


def test_quality_model_learns_and_scores_all(spark, empty):
    rng = np.random.default_rng(0)
    rows, labels = [(None, None), (9001, ""), (9002, "x" * 50_000)], [(None, 1), (5, None)]
    for k in range(400):
        bad = k % 4 == 0
        rows.append((k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 40)) if not bad else "!!! ".join(["SPAM"] * rng.integers(5, 50))))
        labels.append((k, int(not bad)))
    table = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in gam.quality_scores(table, marks).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    test = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out for k in test) and np.mean([got[k].predicted == int(k % 4 != 0) for k in test]) > 0.97
    assert {r.score for r in gam.quality_scores(table, marks.limit(0)).collect()} == {0.5}
    assert gam.quality_scores(empty, marks).count() == 0


def test_held_out_labels_change_no_score_and_scores_are_sums_of_tables(spark):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(rng.choice(["alpha", "Beta!!", "gamma", "7"], int(rng.integers(1, 60))))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(k, int(len(t) % 3 > 0)) for k, t in rows]
    turned = [(k, 1 - y if gam.remainder(k, 4) == 2 else y) for k, y in marks]
    one, two = ({r.doc_id: r.score for r in gam.quality_scores(docs, spark.createDataFrame(m, "doc_id long, quality int")).collect()} for m in (marks, turned))
    assert one == two
    x = gam.features(pa.array([t for _, t in rows]))
    model = gam.train(x, np.array([float(y) for _, y in marks]))
    plain = []
    for row in x:
        fine = [int(np.searchsorted(e, v, "right")) for e, v in zip(model.edges, row, strict=True)]
        coarse = [int(np.searchsorted(e, v, "right")) for e, v in zip(model.edges2, row, strict=True)]
        total = model.base + sum(t[k] for t, k in zip(model.tables, fine, strict=True)) + sum(g[coarse[a], coarse[b]] for (a, b), g in zip(model.pairs, model.grids, strict=True))
        plain.append(1 / (1 + math.exp(-total)))
    assert np.allclose(model.score(x), plain, atol=1e-6)


def test_pairs_of_features_are_learned():
    rng = np.random.default_rng(4)
    x = rng.random((3000, len(gam.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = gam.train(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95


@pytest.mark.parametrize(("a", "b"), [("abcbdab", "bdcaba"), ("", "a"), ("aaaa", "aa"), ("abc", "xyz")])
def test_common_subsequences(a, b):
    pairs = decontaminate.common([ord(x) for x in a], [ord(x) for x in b])
    best = max(n for n in range(len(a) + 1) for c in itertools.combinations(a, n) if all(x in it for it in [iter(b)] for x in c))
    assert len(pairs) == best and all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(pairs))


def test_leaks_are_found_reworded_and_clean_texts_left(spark, docs, empty):
    rng = np.random.default_rng(9)
    items = [(k, " ".join(f"q{rng.integers(0, 3000)}" for _ in range(rng.integers(12, 55))) + ".") for k in range(30)] + [(99, None), (98, "too short")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [(k, t) for k, t in known().items()], set()
    for k in range(30):
        words = items[k][1].split()
        for p in rng.choice(len(words), len(words) // 8, False):
            words[p] = "reworded"
        filler = rng.choice([f"w{n}" for n in range(400)], 300).tolist()
        at = rng.integers(0, 300)
        rows.append((500 + k, " ".join([*filler[:at], *words, *filler[at:]]).upper()))
        want.add((500 + k, k))
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert decontaminate.find_leaks(empty, benchmark).count() == 0
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0


def test_a_leak_in_many_documents_is_found_in_each(spark):
    rng = np.random.default_rng(4)
    filler = [f"w{n}" for n in range(2000)]
    item = [f"q{n}" for n in range(36)]
    reworded = [w if n % 3 else "other" for n, w in enumerate(item)][1:] + item[:1]  # no three words in a row, 24 of 36
    less = [w if n % 4 else "other" for n, w in enumerate(item)]
    rows = []
    for k in range(240):
        words = rng.choice(filler, 150).tolist()
        at = int(rng.integers(0, 150))
        rows.append((k, " ".join([*words[:at], *(item if k % 3 == 0 else less if k % 30 == 1 else reworded if k % 30 == 2 else []), *words[at:]])))
    benchmark = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(f"q{n}" for n in range(100, 130)))], "item_id long, text string")
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, 0) for k in range(240) if k % 3 == 0 or k % 30 == 1}
    assert all(r.lcs_share == 1 for r in got if r.doc_id % 3 == 0)


def longest_common(a, b):
    """Item positions of a longest common subsequence, by the plain table."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if table[i][j] == table[i][j - 1]:
            j -= 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out


def holds(item, words):
    n = len(item)
    if n < decontaminate.SHORT:
        return any(words[k : k + n] == item for k in range(len(words) - n + 1))
    for k in range(max(1, len(words) - n)):
        got = longest_common(item, words[k : k + 2 * n])
        if len(got) >= 0.7 * n and sum(i >= n // 2 for i in got) >= 0.5 * (n - n // 2):
            return True
    return False


def test_leaks_equal_those_of_all_pairs(spark):
    """Every document against every item by the plain table: an item in a tenth of them, short ones, a null doc_id."""
    rng = np.random.default_rng(21)
    draw = lambda n, low, high: [f"t{x}" for x in rng.integers(low, high, n)]
    items = [draw(n, 0, 120) for n in (9, 12, 16, 20, 24, 30, 5, 2, 110)]
    rows = []
    for k in range(80):
        words, planted = draw(60, 40, 900), []
        if k % 10 == 0:
            planted = items[2]
        elif k % 7 == 0:
            planted = list(items[k % len(items)])
            for _ in range(len(planted) // 9):
                planted[rng.integers(len(planted))] = "other"
            for _ in range(len(planted) // 12):
                planted.insert(int(rng.integers(len(planted))), "more")
        elif k % 5 == 0:
            planted = [x for x in items[k % 6] if rng.random() < 0.55]
        elif k % 3 == 0:
            planted = items[6][:4]
        at = int(rng.integers(60))
        rows.append((None if k == 30 else k, " ".join([*words[:at], *planted, *words[at:]])))
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(50, None), (51, " . ")], "item_id long, text string")
    want = {(d, k) for d, t in rows for k, item in enumerate(items) if holds(item, t.split())}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert len(want) > 15 and (None, 2) in want and any(k == 6 for _, k in want)
    assert got == want
    three = [(1, "a b"), (2, " ".join(items[3])), (3, None)]
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(three, "doc_id long, text string"), benchmark).collect()} == {(2, 3)}


def test_rewordings_without_a_common_run_are_found_by_cosine(spark):
    """No three words of an item stand in a row; what is kept (70 to 75 %) is spread over twice the length."""
    rng = np.random.default_rng(2)
    items = [[f"q{x}" for x in rng.integers(0, 4000, 36)] for _ in range(120)]
    filler = [f"w{n}" for n in range(3000)]
    rows = []
    for k in range(120):
        spread = [y for n, x in enumerate(items[k]) if n % 4 for y in ((x,) if n % 2 else (x, str(rng.choice(filler))))]
        words = rng.choice(filler, 200).tolist()
        rows.append((k, " ".join([*words[:90], *spread, *words[90:]])))
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got <= {(k, k) for k in range(120)} and len(got) >= 114


def every_segmentation(lattice, text):
    out = []

    def go(at, score, ids):
        if at == len(text):
            out.append((score, tuple(ids)))
        for end in range(at + 1, len(text) + 1):
            if found := lattice.pieces.get(text[at:end]):
                go(end, score + found[1], [*ids, found[0]])
        if at < len(text) and text[at] not in lattice.pieces:
            go(at + 1, score + lattice.byte_score, [*ids, *(lattice.byte_ids[b] for b in text[at].encode())])

    go(0, 0.0, [])
    return sorted(out, reverse=True)


@pytest.mark.parametrize("text", ["hello the cat", "aaaaaa", "é ç\n", "x  y", "▁", "ab ｆ"])
@pytest.mark.parametrize("n", [1, 2, 5])
def test_n_best_segmentations(text, n):
    lattice = pieces.Lattice.load(tokenizers_at("piece_bpe_32k.model"))
    want = every_segmentation(lattice, lattice.normalize(text))
    got = lattice.nbest(text, n)
    assert [s for s, _ in got] == [s for s, _ in want[:n]]
    ids = [tuple(np.frombuffer(x, "<u4").tolist()) for _, x in got]
    assert len(set(ids)) == len(ids) and set(zip([s for s, _ in got], ids, strict=True)) <= set(want)
    assert all(lattice.decode(np.frombuffer(x, "<u4")) == text.replace("▁", " ") for _, x in got)


def test_many_words_are_searched_as_one_by_one():
    lattice = pieces.Lattice.load(tokenizers_at("piece_bpe_32k.model"))
    rng = np.random.default_rng(5)
    letters = list("etaoinshr▁.ßñ\n\x00ｆ一𝄞")
    words = ["▁" + "".join(rng.choice(letters, k % 23)) for k in range(600)] + ["x" * 70, "▁" * 65 + "a"]
    flat, start, size, score, loss = lattice.best_two(words)
    for k, x in enumerate(words):
        (best, ids), *rest = lattice.segment(x, 2)
        assert (score[k], loss[k]) == (best, best - rest[0][0] if rest else math.inf)
        assert tuple(flat[start[k] : start[k] + size[k]].tolist()) == ids


def test_pieces_of_documents(docs, empty):
    """Scores equal those of one search over the whole text's lattice, and ids add up to their scores."""
    model = tokenizers_at("piece_bpe_32k.model")
    got = {r.doc_id: r for r in pieces.encoded(docs, model, n=3).collect()}
    lattice = pieces.Lattice.load(model)
    worth = dict(lattice.pieces.values()) | dict.fromkeys(lattice.byte_ids, None)
    assert any(len(t or "") > 2000 for t in known().values())
    for k, t in known().items():
        r = got[k]
        assert r.round_trip and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert [r.score, *r.next_scores] == [s for s, _ in lattice.segment(lattice.normalize(t or ""), 3)]
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.n_pieces == len(ids) and r.ids_crc32 == zlib.crc32(r.ids) and len({r.ids_crc32, *r.next_crc32}) == 1 + len(r.next_crc32)
        if all(worth[x] is not None for x in ids):
            assert sum(worth[x] for x in ids) == r.score
    assert pieces.encoded(empty, model).count() == 0


@pytest.mark.parametrize(("length", "start"), [(13, 7), (4, 1), (9, 2), (5, 5)])
def test_substring_dedup(docs, empty, length, start):
    got = {r.doc_id: r for r in substrings.dedup_substrings(docs, length, start).collect()}
    words = {k: WORD.findall(t or "") for k, t in known().items()}
    first = {}
    for k in sorted(words, key=last):
        for p in range(len(words[k]) - length + 1):
            first.setdefault(tuple(words[k][p : p + length]), k)
    for k, w in words.items():
        gone = set()
        for p in range(len(w) - length + 1):
            if last(first[tuple(w[p : p + length])]) < last(k):
                gone |= set(range(p, p + length))
        assert (got[k].n_words, got[k].n_removed, got[k].text) == (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)), k
    assert substrings.dedup_substrings(empty).count() == 0
