"""Conversation repair, personal data and vector codes against plain versions on small tables with odd cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import codebooks, personal, queries, turns

BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Cost, audit and lines of the best repair, by trying every edit at every turn and state."""
    seen, kinds, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in rows:
        body = text.strip(BLANK)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        kinds.append(fault)
        if fault:
            counts[fault] += 1
    then = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def add(cost, letter, line, i, state, inserted=0):
            c, audit, lines = best(i, state, inserted)
            found.append((cost + c, letter + audit, line + lines))

        for role in ("user", "assistant"):
            if (state, role[0]) in then and inserted < 3:
                add(5, "I", ((role, ""),), i, then[state, role[0]], inserted + 1)
        if i < len(rows):
            (role, text), more = rows[i], 5 * (kinds[i] == "truncated")
            add(2, "D", (), i + 1, state)
            if kinds[i] not in ("blank", "duplicate"):
                if (state, role[:1]) in then:
                    add(more, "K", ((role, text),), i + 1, then[state, role[:1]])
                for other in ("user", "assistant"):
                    if (state, other[0]) in then:
                        add(more + 1, "R", ((other, text),), i + 1, then[state, other[0]])
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0), counts


def told(conversation):
    """What the report says of turns (turn, role, text), sorted."""
    rows = [(r, t) for _, r, t in conversation]
    (cost, audit, lines), counts = cheapest(rows)
    numbers = [t for t, _, _ in conversation if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    first = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return {"gaps": gaps, **counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": digest}


def conversations():
    rng = np.random.default_rng(11)
    texts = ["Yes.", "No!", "why", "well then", "", " \n", "Ok?", "é…", None, "long " * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "umpire", None]
    rows = []
    for conv in range(60):
        at = 0
        for _ in range(rng.integers(1, 12 if conv else 60)):
            at += int(rng.integers(0, 3))
            rows.append((conv, None if rng.random() < 0.05 else at, roles[rng.integers(0, len(roles))], texts[rng.integers(0, len(texts))], "x", 7))
    rows += [(None, 1, "user", "Hi.", None, None), (None, 1, "user", "Hi.", None, None), (None, 2, "assistant", "Yes.", None, None)]
    rows += [(99, None, "tool", "Hi.", None, None), (98, 5, None, None, None, None)]
    return rows


TURNS = "conv_id long, turn long, role string, text string, part string, whole long"


def sorted_turns(rows):
    """Conversations as the operator takes them; nulls of role and text are a space."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {c: sorted(x, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode())) for c, x in out.items()}


def as_rows(df):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


@pytest.mark.parametrize("piece", [3, 4096])
def test_repairs_equal_trying_every_edit(spark, piece):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    want = {c: told(x) for c, x in sorted_turns(rows).items()}
    assert as_rows(turns.report(turns.repaired(df, piece=piece), df)) == want


def test_repaired_turns_follow_the_grammar(spark):
    df = spark.createDataFrame(conversations(), TURNS)
    grammar = re.compile("(s?(ua)+)?")
    whole = turns.repaired(df).where("whole").collect()
    assert whole and all(grammar.fullmatch("".join(t["role"][0] for t in r["repaired"])) for r in whole)
    assert turns.repaired(df.limit(0)).count() == 0
    assert turns.report(turns.repaired(df.limit(0)), df.limit(0)).count() == 0


def test_a_conversation_in_many_pieces(spark):
    rows = [(1, k, "assistant" if k % 3 else "user", f"turn {k % 400}{'.' if k % 7 else ''}", "", 0) for k in range(1500)]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    whole, cut = (turns.report(turns.repaired(df, piece=p), df).first() for p in (4096, 64))
    assert whole == cut and whole["duplicate"] == len(rows) - len({r[2:4] for r in rows})
    audit = turns.solve([x for x in sorted_turns(rows)[1]])
    assert (audit["audit"], audit["cost"]) == (cut["audit"], cut["cost"])


def test_damage_by_checksum(spark, tmp_path):
    rows = [(c, t, "assistant" if t % 2 else "user", f"One. Two {c} {t}!", "", 0) for c in range(40) for t in range(6)] + [(7, None, "user", None, "", 0), (None, None, None, "Ok.", "", 0)]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    want, left = {}, {}
    for conv, turn, role, text, *_ in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        want.setdefault(conv, [])
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        left.setdefault(conv, []).extend([(conv, turn, "user" if fault == 4 else role, text)] * (fault and 1 + (fault == 3)))
    sorts = {c: sorted_turns(x).get(c, []) for c, x in left.items()}
    assert as_rows(queries.op11_turns(spark, str(tmp_path))) == {c: told(x) for c, x in sorts.items()}


# ---- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def check_digit(digits):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda d=digits: 12 <= len(d) <= 19 and check_digit(d), "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]():
                out.append((m.start(), list(PLAIN).index(kind), kind, m.end()))
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(out)]


def odd_texts():
    rng = np.random.default_rng(3)
    texts = [None, "", " ", "a@b.c", "é@b.c x@y@z.com", "a@b.c@d.e", "a@b.c_d@e.f", "@d.e@f.g", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.01.1.1x", "1.2.3.4" * 3]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (578) 555-6437 4918187128635271", "z" * 40_000 + "@", "1" * 30_000, "9 " * 20_000, "Ü" * 100 + "+44 20 7946 0958", "x\n+1\n234 567 8901", "a@b.c\n" * 50]
    for alphabet in ("ab@.-_", "012.+ ", "0123456789 -", "+0123456789 ().-", "aé1@.+- \n4"):
        texts += ["".join(rng.choice(list(alphabet), rng.integers(1, 60))) for _ in range(150)]
    return texts


def test_base_spans_equal_the_plain_expressions(spark, tmp_path):
    texts = odd_texts()
    rows = [(k, t, "s", "e", 0.0, "b") for k, t in enumerate(texts)] + [(None, "a@b.c", None, None, None, None), (3, "a@b.c", "s", "e", 0.0, "b")]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, kind string, score double, base string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_personal(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((k is None, k or 0) for k, *_ in rows)
    for r in got:
        text = "a@b.c" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        want = base_spans(text)
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text[:80]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(w.startswith(f"{k}:") for w in want) for k in PLAIN]
        listed = r["spans"].split(",") if r["spans"] else []
        assert set(want) <= set(listed)
        places = [(int(s.split(":")[1]), personal.KINDS.index(s.split(":")[0])) for s in listed]
        assert places == sorted(places)
    assert personal.find_personal(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("call +1 (578) 555-6437 4918187128635271 now", "card", "4918187128635271"),
    ("call +1 (578) 555-6437 4918187128635271 now", "phone", "+1 (578) 555-6437"),
    ("IBAN GB82 WEST 1234 5698 7654 32 thanks", "iban", "GB82 WEST 1234 5698 7654 32"),
    ("IBAN GB83 WEST 1234 5698 7654 32 thanks", "iban", None),
    ("my ssn is 123-45-6789", "ssn", "123-45-6789"),
    ("code 123-45-6789", "ssn", None),
    ("phone: (212) 555-0187", "phone", "(212) 555-0187"),
    ("order 212-555-0187", "phone", None),
    ("numbers 1234 5678 9012 3456 7890 1234", "card", None),
])
def test_further_spans(text, kind, found):
    spans = personal.spans_of(pa.array([text]), 0.6).to_pylist()[0]
    assert [text[s["start"] : s["end"]] for s in spans if s["kind"] == kind] == ([found] if found else [])


def test_words_nearby_move_the_score():
    value = lambda t: personal.spans_of(pa.array([t]), 0.6).to_pylist()[0][0]["score"]
    assert value("card 4111111111111111") > value("4111111111111111") > value("order 4111111111111111")


# ---- vector codes

VECTORS = "vec_id long, embedding array<float>, label int, pos int, part string, row long"


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    kept = sorted(((i, v + [0] * (width * parts - len(v)), lab) for i, v, lab in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[tuple(v[p * width : (p + 1) * width]) for _, v, _ in kept] for p in range(parts)]
    books = [c[:entries] for c in cut]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (gap(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            mine = [near(p, x) for x in cut[p]]
            sets = [[x for x, m in zip(cut[p], mine) if m == e] for e in range(len(books[p]))]
            books[p] = [tuple(sum(c) // len(s) for c in zip(*s)) if s else b for s, b in zip(sets, books[p])]
    codes = [[near(p, cut[p][k]) for p in range(parts)] for k in range(len(kept))]
    errors = [sum(gap(cut[p][k], books[p][e]) for p, e in enumerate(code)) for k, code in enumerate(codes)]
    sums = {}
    for (_, _, lab), e in zip(kept, errors):
        sums[lab] = sums.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for entry in b for x in entry).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for e in code), err, sums[lab], digest) for (i, _, lab), code, err in zip(kept, codes, errors)]


@pytest.mark.parametrize(("parts", "entries", "scale"), [(4, 256, 0.2), (4, 5, 0.2), (2, 3, 4000.0)])
def test_codes_equal_plain_rounds(spark, parts, entries, scale):
    rng = np.random.default_rng(9)
    rows = [(int(k), [float(np.float32(x)) for x in np.round(rng.normal(0, scale, 8), 2)], int(k % 3), 1, "a", 2) for k in rng.permutation(120)]
    same = rows[5][1]
    rows += [(k, same, None, 1, "a", 2) for k in range(200, 240)] + [rows[0], (rows[1][0], rows[2][1], 1, 1, "a", 2), (None, same, None, None, None, None)]
    rows += [(300, None, 1, 1, "", 1), (301, [1.0, None] * 4, 1, 1, "", 1), (302, [math.nan] * 8, 1, 1, "", 1), (303, [math.inf] * 8, 1, 1, "", 1), (304, [0.5], 1, 1, "", 1), (305, [], None, 1, "", 1)]
    got = codebooks.compressed(spark.createDataFrame(rows, VECTORS).repartition(3), parts=parts, entries=entries).drop("label").collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=order) == sorted(plain_codes(rows, parts, entries, 4), key=order)


def test_vectors_without_numbers_give_no_rows(spark):
    assert codebooks.compressed(spark.createDataFrame([], VECTORS)).count() == 0
    assert codebooks.compressed(spark.createDataFrame([(1, None, 1, 1, "", 1)], VECTORS)).count() == 0


def test_large_components_are_exact():
    rng = np.random.default_rng(1)
    rows, book = rng.integers(-(1 << 28), 1 << 28, (50, 6)), rng.integers(-(1 << 28), 1 << 28, (7, 6))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, e)) for e in book] for x in rows]
    index, gap = codebooks.nearest(rows, book)
    assert gap.tolist() == [min(w) for w in want] and index.tolist() == [w.index(min(w)) for w in want]


def test_registered_queries_cover_their_tables(spark):
    sf = "/root/testdata/sf0.001"
    for name, key, of in (("op11_turns", "conv_id", "conversations"), ("op12_personal", "doc_id", "documents"), ("op13_codebooks", "vec_id", "embeddings")):
        got = queries.queries()[name](spark, sf).select(key)
        want = spark.read.parquet(f"{sf}/{of}.parquet").select(key)
        assert got.count() == want.select(F.col(key)).distinct().count()
