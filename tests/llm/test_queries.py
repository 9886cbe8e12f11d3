"""The registered queries against plain Python on the smallest tables, and on small tables of hard cases."""

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomweave.llm import queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket int, row string"
LONG = " ".join(f"w{i * 7919 % 1009}" for i in range(30_000))
SHARED = " ".join(f"shared{i}" for i in range(40))
HARD = [
    (1, None), (2, ""), (3, "one"), (4, "One"), (5, "two words"), (6, "a b c"), (7, SHARED), (8, SHARED), (9, SHARED.replace("shared7 ", "")), (10, f"before {SHARED} after"),
    (11, LONG), (12, LONG + " end"), (13, "x" * 20_000), (14, "1" * 30_000), (15, "1.2." * 5_000), (16, "a@" * 5_000 + "b@c.de"), (17, "\n\n  \n"), (18, "Tail line here\n TAIL LINE HERE \nother"),
    (19, "tail line here"), (20, "call +1 (204) 555-0100 or mail a.b@c.org_d@e.fr, card 4111 1111 1111 1111, ip 010.0.0.255 1.2.3.256"), (21, "é" * 50 + " 4111111111111111 😀 x@y.zz"),
    (22, "\u00a0a\u00a0b \u2003c"), (22, "\u00a0a\u00a0b \u2003c"), (23, "<|endoftext|> and <|endoftext|>x"), (24, "password=0123456789abcdef0123 IBAN GB82WEST12345698765432 GB83WEST12345698765432"),
    (25, " ".join(["dup"] * 200)), (26, "  lead\ttrail  \r\n  \x0b\x0c " * 30), (27, "日本語のテキスト" * 300), (None, SHARED), (None, None),
]

TESTS = [(1, SHARED, "r"), (2, SHARED.upper().replace(" ", " -- "), "r"), (10, " ".join(LONG.split()[5_000:5_012]), "r"), (11, "one", "r"), (11, "two", "r"), (3, "two words", "r"), (4, "two wordsx", "r"), (5, None, "r"),
         (6, " ,;: ", "r"), (None, "tail line", "r"), (7, "x" * 20_000, "r"), (8, "dup " * 12, "r"), (9, "日本語のテキスト" * 300, "r"), (12, "c\u00a0b", "r"), (13, "b \u2003c", "r"), (1, "c", "r")]


@pytest.fixture(scope="module", params=["tables", "hard", "empty"])
def folder(request, spark, sf_dir, tmp_path_factory):
    if request.param == "tables":
        return sf_dir
    rows = [(i, t, "en", "s", 0, "k", 1, "r") for i, t in HARD] if request.param == "hard" else []
    path = str(tmp_path_factory.mktemp("hard"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    items = TESTS if request.param == "hard" else []
    spark.createDataFrame(items, "item_id long, text string, row string").repartition(2).write.parquet(f"{path}/benchmark.parquet")
    return path


def texts(spark, folder):
    return sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()), key=lambda r: (r[0] is None, r))


def rows(df, *columns):
    """The columns as sorted tuples; rows without an id last."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: (r[0] is None, str(r)))


def same(got, want):
    assert got == sorted(want, key=lambda r: (r[0] is None, str(r)))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_op1(spark, folder):
    import public_tokenizers

    from roomweave.llm import bpe

    e = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = []
    for i, t in texts(spark, folder):
        ids = e.encode_ordinary(t)
        want.append((i, len(ids), sha(array("I", ids).tobytes()), sha(t)))
    same(rows(q.op1_bpe(spark, folder), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), want)


def test_op1_tree():
    """Trees of very small leaves give what the library gives, for texts of many kinds of characters."""
    import random

    import public_tokenizers

    from roomweave.llm import bpe

    e, chance = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken")), random.Random(5)
    for _ in range(3_000):
        text = "".join(chance.choice("aab  \n\t.,'sé日😀\u00a0\u20281\r") for _ in range(chance.randrange(60)))
        ids = bpe.encode_tree(e.encode_ordinary, text, chance.randrange(1, 9))
        assert ids == e.encode_ordinary(text) and bpe.decode_tree(e.decode_bytes, ids, chance.randrange(1, 9)) == text.encode()


def test_op1_op10_same_names(spark):
    """Columns of the new names are replaced, others stay; an empty table stays empty."""
    import public_tokenizers

    from roomweave.llm import bpe, chat

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    one = spark.createDataFrame([(1, "a b", "old", 7)], "doc_id long, text string, ids string, layout int")
    row = bpe.decode(bpe.encode(one, path), path).first()
    assert bytes(row.decoded) == b"a b" and row.layout == 7 and bpe.encode(one.limit(0), path).count() == 0
    made = chat.read_back(chat.format_turns(chat.to_turns(one.withColumn("record", F.lit('{"prompt": "p", "completion": "c"}')).withColumn("turns", F.lit(1)))))
    row = made.first()
    assert row.loss_text == "c" and row.ids == "old" and chat.to_turns(one.limit(0), "text").count() == 0


def test_op10_layouts(spark):
    from roomweave.llm import chat

    turns = {
        '{"messages": [{"role": "human", "content": "x"}, {"role": "gpt", "content": "y"}]}': [("human", "x"), ("gpt", "y")],
        '{"id": "7", "system": "s", "conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": null}]}': [("system", "s"), ("user", "x"), ("assistant", "")],
        '{"prompt": "x", "response": "y"}': [("user", "x"), ("assistant", "y")],
        '{"instruction": "x", "input": "", "output": "y"}': [("user", "x"), ("assistant", "y")],
        '{"instruction": "x", "input": "i", "output": "y"}': [("user", "x\n\ni"), ("assistant", "y")],
        '{"question": "x", "context": "c", "answer": "y"}': [("user", "c\n\nx"), ("assistant", "y")],
        '{"data": {"prompt": "x", "completion": "y"}}': [("user", "x"), ("assistant", "y")],
        '{"messages": []}': [], '{"a": 1}': None, "{": None, "": None,
    }
    got = {r.record: r for r in chat.to_turns(spark.createDataFrame([(r,) for r in turns], "record string")).collect()}
    assert {k: None if r.turns is None else [tuple(t) for t in r.turns] for k, r in got.items()} == turns
    assert got['{"a": 1}'].layout and got["{"].layout is None


def test_op7_sql(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet{'/*.parquet' if folder.startswith('/tmp') else ''}')")
    want = con.execute(q.oracle_sql()["op7_line_dedup"]).fetchall()
    same(rows(q.op7_line_dedup(spark, folder), "doc_id", "n_lines", "n_dropped", "kept_sha256"), want)


SPANS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, x):
    digits = [int(c) for c in x if c.isdigit()]
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in x.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def test_op3(spark, folder):
    want = []
    for i, t in texts(spark, folder):
        # The plain patterns take quadratic time on runs without a match.
        at = {k: [m.span() for m in re.finditer(p, t) if holds(k, m.group())] for k, p in SPANS.items() if not (k in ("ip", "email") and t in ("1" * 30_000, "x" * 20_000))}
        base = ",".join(f"{k}:{a}:{b}" for k in SPANS for a, b in at.get(k, []))
        want.append((i, *(len(at.get(k, [])) for k in SPANS), sha(base)))
    got = q.op3_pii(spark, folder)
    same(rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"), want)


def test_op3_context(spark):
    """Words nearby decide over spans of the added kinds, both ways; account numbers also in groups of four."""
    from roomweave.llm import pii

    rows = [(1, "My SSN is 123-45-6789 ok"), (2, "code 123-45-6789 ok"), (3, "SSN 000-45-6789"), (4, "pay GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765432 not GB83WEST12345698765432"), (5, "placeholder GB82WEST12345698765432")]
    got = {r.row.doc_id: [(s.kind, s.start, s.end, s.score) for s in r.spans] for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [("ssn", 10, 21, 0.65)], 2: [], 3: [], 4: [("iban", 4, 31, 0.7), ("iban", 35, 57, 0.7)], 5: []}


def test_op3_masks(spark):
    """Also thousands of spans, spans that overlap, and characters outside the basic plane."""
    from roomweave.llm import pii

    rows = [(1, "mail \U0001f600 a@b.cc and " * 4_000), (2, "x +49 30 1234567 y"), (3, "+1 4111 1111 1111 1111"), (4, None), (5, "")]
    got = {r.row.doc_id: r.masked for r in pii.with_masked(pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: "mail \U0001f600 [EMAIL] and " * 4_000, 2: "x [PHONE] y", 3: "+1 4111 1111 1111 1111", 4: "", 5: ""}


def grams(t, n):
    w = WORD.findall(t.translate(LOWER))
    return frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked(docs, n, percent):
    """{doc_id: component} by counting all shared shingles."""
    held, up, sets = defaultdict(list), {i: i for i, _ in docs}, {}
    root = lambda x: x if up[x] == x else root(up[x])
    for i, t in docs:
        sets[i] = s = grams(t, n)
        both = Counter(k for g in s for k in held[g])
        for g in s:
            held[g].append(i)
        for k, x in both.items():
            if 100 * x >= percent * (len(s) + len(sets[k]) - x):
                a, b = root(i), root(k)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in up}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_op4(spark, folder, n, percent):
    from roomweave.llm import ngram_join

    docs = [(i, t) for i, t in texts(spark, folder) if i is not None]
    component = linked(list(dict(docs).items()), n, percent)
    got = ngram_join.join_ngrams(spark.read.parquet(f"{folder}/documents.parquet"), n, percent).where("doc_id IS NOT NULL")
    same(rows(got, "doc_id", "n_shingles", "component_id"), [(i, len(grams(t, n)), component[i]) for i, t in docs])


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_op4_rounds(spark, monkeypatch, rounds):
    """Buckets whose hubs are far from groups of near copies, all with one passage in common; also by prefixes alone."""
    from roomweave.llm import ngram_join

    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    passage, docs = words("p", 60), []
    for group in range(3):
        for i in range(6):
            own = words(f"g{group}", 240 if group else 30)
            own[3 * i] = f"x{group}{i}"
            docs.append((len(docs), " ".join(passage + own)))
    docs += [(100 + i, " ".join(passage + words(f"s{i}", 150))) for i in range(8)]
    for percent in (60, 80, 90):
        got = ngram_join.join_ngrams(spark.createDataFrame(docs, "doc_id long, text string"), n=5, percent=percent)
        component = linked(docs, 5, percent)
        assert {r.doc_id: r.component_id for r in got.collect()} == {i: component[i] for i, _ in docs}


def thue_morse(n):
    """Two words of n letters that polynomials modulo powers of two do not tell apart."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes(spark):
    import pyarrow as pa

    from roomweave.llm import wordhash

    for n in (1024, 2048, 4096, (1 << 21) + 3):
        one, two = thue_morse(n)
        h = wordhash.Words(pa.array([f"{one} x {two}", two, f" {one}"])).hashes
        assert h[0] != h[2] and h[2] == h[3] and h[0] == h[4]
    words = [f"w{i}" * (i % 5 + 1) for i in range(20_000)]
    h = wordhash.Words(pa.array([" ".join(words), " ".join(reversed(words))])).hashes
    assert len(set(h[:20_000].tolist())) == 20_000 and (h[:20_000] == h[20_000:][::-1]).all()


def test_words_alike(spark, tmp_path):
    """Different words of equal polynomials modulo 2**64 neither link nor repeat."""
    one, two = thue_morse(2048)
    around = " ".join(f"w{k}" for k in range(30))
    docs = [(1, f"{one} {around} {one}"), (2, f"{two} other words {two}"), (3, " ".join([one] + [f"z{k}" for k in range(14)])), (4, " ".join([two] + [f"z{k}" for k in range(12)])), (5, "\n".join([one, two]))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.component_id for r in q.op4_ngram_join(spark, str(tmp_path)).orderBy("doc_id").collect()] == [1, 2, 3, 4, 5]
    assert [r.n_removed for r in q.op5_substring_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()] == [0, 0, 0, 0, 0]
    assert [r.n_dup_lines for r in q.op9_quality(spark, str(tmp_path)).orderBy("doc_id").collect()] == [0] * 5


def test_op5(spark, folder):
    seen, want, docs = {}, [], texts(spark, folder)
    for i, t in docs:
        if i is not None:
            w = WORD.findall(t)
            for j in range(len(w) - 12):
                seen.setdefault(tuple(w[j : j + 13]), i)
    for i, t in docs:
        w, drop = WORD.findall(t), set()
        for j in range(len(w) - 12) if i is not None else ():
            if seen[tuple(w[j : j + 13])] < i:
                drop.update(range(j, j + 13))
        want.append((i, len(w), len(drop), sha(" ".join(x for j, x in enumerate(w) if j not in drop))))
    same(rows(q.op5_substring_dedup(spark, folder), "doc_id", "n_words", "n_removed", "kept_sha256"), want)


def test_op6(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, x in texts(spark, folder):
        ids = t.encode(x, add_special_tokens=False).ids + [1]
        want[i, array("I", ids).tobytes()] += 1
    from roomweave.llm import packing

    pieces = packing.pack(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(p.ids) and p.length * 4 == len(p.ids) and 0 < p.length <= 2048
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for i, own in docs.items():
        whole = [ids for (d, ids), n in want.items() if d == i for _ in range(n)]
        assert sum(p.length for p in own) == sum(len(w) // 4 for w in whole)
        if len(whole) == 1:
            assert b"".join(p.ids for p in sorted(own, key=lambda p: p.start)) == whole[0]
            assert [p.start for p in sorted(own, key=lambda p: p.start)][0] == 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert set(docs) == {i for i, _ in want}


def test_op7(spark, folder):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    docs, holders, want = texts(spark, folder), defaultdict(set), []
    for i, t in docs:
        for line in t.split("\n") if i is not None else ():
            holders[key(line)].add(i)
    for i, t in docs:
        lines = t.split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        want.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    same(rows(q.op7_line_dedup(spark, folder), "doc_id", "n_lines", "n_dropped", "kept_sha256"), want)


def test_op9(spark, folder):
    want = []
    for i, t in texts(spark, folder):
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        count = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        repeat = {k for j in range(len(w) - 2) if count[tuple(w[j : j + 3])] > 1 for k in range(j, j + 3)}
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w)))
    got = q.op9_quality(spark, folder)
    same(rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), want)
    assert not got.where("base_failed AND kept").count()


def test_op9_agrees_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    r = q.op9_quality(spark, folder).join(labels, "doc_id").where("NOT base_failed").agg(F.avg(F.expr("CASE WHEN quality = 1 THEN int(kept) END")).alias("good"), F.avg(F.expr("CASE WHEN quality = 0 THEN int(NOT kept) END")).alias("bad")).first()
    assert r.good > 0.97 and r.bad > 0.8


def nearest(table, k=5):
    ok = {i: np.array(v, dtype=float) for i, v in table if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for i in ok:
        if i % 50 == 0:
            score = {j: float(v @ ok[i] / np.sqrt((v @ v) * (ok[i] @ ok[i]))) for j, v in ok.items() if j != i}
            out += [(i, r + 1, j, s) for r, (j, s) in enumerate(sorted(score.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k])]
    return out


@pytest.mark.parametrize("few", [False, True])
def test_op8(spark, sf_dir, few, tmp_path):
    if few:
        bad = [(0, [1.0, 2.0]), (1, [2.0, 4.0]), (2, [1.0, 2.0]), (50, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (2, [1.0, 2.0])]
        spark.createDataFrame(bad, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
        sf_dir = str(tmp_path)
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in q.op8_nearest(spark, sf_dir).collect())
    want = sorted(nearest(table))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=0, atol=1e-12)


@pytest.mark.parametrize("hard", [False, True])
def test_op10(spark, sf_dir, hard, tmp_path):
    if hard:
        odd = [(1, 0, "user", None), (1, 1, "assistant", "\\\\### user:\n</turn>\n"), (2, 0, None, "x"), (3, 1, "a:\n</turn>", "\\"), (3, 0, "assistant", ""), (4, 0, "assistant", "é😀"), (4, 0, "assistant", "é😀")]
        spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
        sf_dir = str(tmp_path)
    table = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        table[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    table[-7] = [(0, "user", r"\### Assistant: </turn> ok"), (1, "assistant", r"\### Assistant: </turn> ok")]
    want = []
    for i, turns in table.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want.append((i, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    same(rows(q.op10_chat(spark, sf_dir), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"), want)


def article(html):
    """What the generated pages hold in their article, read plainly."""
    from html import unescape

    m = re.search(r"<article>(.*?)</article>", html, re.S)
    parts = re.split(r"</?(?:p|h[1-6]|br|div|li|ul)[^>]*>", m[1])
    return " ".join(x for x in (" ".join(unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if x)


def test_op2(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    want = [(r.page_id, r.url, article(r.html), len(article(r.html))) for r in pages]
    same(rows(q.op2_html_extraction(spark, sf_dir), "page_id", "url", "text", "n_chars"), want)


def read(spark, pages):
    """{page_id: text} of pages [(url, html)], numbered."""
    from roomweave.llm import html_extract

    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.extract(table).collect()}


def body(*parts):
    return "<html><body>" + "".join(parts) + "</body></html>"


def test_op2_templates_without_names(spark, sf_dir):
    """The tables' pages, their article a plain div: the templates find the same text; and text of templates in an article goes."""
    pages = [(r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    renamed = [(u, h.replace("<article>", "<div>").replace("</article>", "</div>")) for u, h in pages]
    assert read(spark, renamed) == {i: article(h) for i, (_, h) in enumerate(pages)}
    shared = [("http://a.example/", body(f"<article><p>Only here {i}.</p><p>Write to the desk.</p></article><!-- <main> -->")) for i in range(4)]
    assert read(spark, shared) == {i: f"Only here {i}." for i in range(4)}
    in_comment = [("http://a.example/", body("<!-- <main> -->", f"<div class=x><p>Said {i}.</p></div><div class=y>Same on all</div>")) for i in range(4)]
    assert read(spark, in_comment) == {i: f"Said {i}." for i in range(4)}


def test_op2_keeps_all_slots(spark):
    """Siblings, two layouts of a host, ids of single pages, copies, and pages without a host."""
    def one(i):
        return body(f"<div class=post id=post-{i}><section class=intro>Intro {i}.</section><section class=body>Body text {i}.<ul><li>Point {i}</li></ul></section></div><div class=x>On all pages</div>")

    def two(i):
        return body(f"<table class=old><tr><td>Cell {i}.</td></tr></table><div class=x>On all pages</div><div class=x>Old layout</div>")

    for url in ("http://a.example/1", None):
        pages = [(url, one(i)) for i in range(8)] + [(url, two(i)) for i in range(8, 12)]
        assert read(spark, pages) == {i: f"Intro {i}. Body text {i}. Point {i}" if i < 8 else f"Cell {i}." for i in range(12)}
    assert read(spark, [("http://b.example/", one(7))] * 5) == {i: "Intro 7. Body text 7. Point 7 On all pages" for i in range(5)}


def test_op2_without_any_names(spark, sf_dir):
    """With the lists of names emptied, templates read the article of every page whose host has three pages or more."""
    from roomweave.llm import html_extract

    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    hosts = Counter(r.url.split("/")[2] for r in table.collect())
    want = {r.page_id: article(r.html) for r in table.collect() if hosts[r.url.split("/")[2]] >= 3}
    got = {r.page_id: r.text for r in html_extract.extract(table, html_extract.NONE).collect()}
    assert want and {i: got[i] for i in want} == want
    made = html_extract.templates(html_extract._hosts(table), html_extract.NONE).collect()
    assert len(made) == sum(n >= 3 for n in hosts.values()) and all(r.regions for r in made)


def test_op2_long_pages(spark):
    """Deep nesting, many closing tags without a start, a very long text: whole results in time that grows with the page."""
    deep = body("<div>" * 20_000, "<article>kept", "</p>" * 20_000, "<p>and this", "</article>", "</div>" * 20_000, "<footer>gone</footer>", "</section>" * 20_000)
    long = body("<nav>menu</nav><article><p>", "word " * 200_000, "</p></article>")
    assert read(spark, [(None, deep), ("http://x.example", long)]) == {0: "kept and this", 1: ("word " * 200_000).strip()}


def test_op9_noisy_rule():
    """Where one rule also votes against many clean documents, these stay; documents that several rules reject go."""
    from roomweave.llm import quality

    rules = len(quality.RULES)
    clean, junk = "+" * rules, "++--" + "+" * (rules - 4)
    for k in range(rules):
        noisy = "+" * k + "-" + "+" * (rules - k - 1)
        found = quality.estimate({clean: 7800, junk: 330, "++---" + "+" * (rules - 5): 300, "+++++---" + "+" * (rules - 8): 160, noisy: 1000})
        assert found[clean] > 0.9 and found[noisy] > 0.5 and found[junk] < 0.1


def graded(t):
    """The votes of a text, from the text by plain Python."""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    n, chars, letters, upper = len(w), sum(map(len, w)), len(re.findall("[A-Za-z]", t)), len(re.findall("[A-Z]", t))
    bars, shouts, digits, twice = t.count("|"), t.count("!"), len(re.findall("[0-9]", t)), len(lines) - len(set(lines))
    other = sum(t.count(c) for c in "#*$%&<>")
    grams = Counter(zip(w, w[1:], w[2:]))
    repeat = len({k for j in range(n - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(j, j + 3)})
    rules = [
        (n < 20, n < 50, n >= 100),
        (chars < 2 * n or chars > 12 * n, chars < 3 * n or chars > 10 * n, 3.5 * n <= chars <= 9 * n),
        (10 * other > 3 * n, 10 * other > n, 50 * other <= n),
        (5 * bars > n, 20 * bars > n, 50 * bars <= n),
        (2 * upper > letters, 10 * upper > 3 * letters, 5 * upper <= letters),
        (5 * shouts > n, 10 * shouts > n, 50 * shouts <= n),
        (2 * repeat > n or (twice >= 3 and 40 * twice > n), 10 * repeat > n or twice >= 1, 20 * repeat <= n),
        (2 * digits > chars, 4 * digits > chars, 10 * digits <= chars),
    ]
    failed = n < 50 or 100 * repeat > 50 * n
    return "".join("=" if s else "-" if k else "+" if g else "0" for s, k, g in rules), failed


def plain_estimate(counts, rounds=200):
    """Posteriors of vote patterns: the estimation as written in the docstring, document by document and rule by rule."""
    m = len(next(iter(counts)))
    share, tables = 0.8, {True: [{"+": 0.995, "-": 0.0045, "=": 0.0005} for _ in range(m)], False: [{"+": 0.6, "-": 0.2, "=": 0.2} for _ in range(m)]}
    for _ in range(rounds):
        post = {}
        for p in counts:
            good = share * math.prod(tables[True][k][v] for k, v in enumerate(p) if v != "0")
            bad = (1 - share) * math.prod(tables[False][k][v] for k, v in enumerate(p) if v != "0")
            post[p] = good / (good + bad) if "-" in p or "=" in p else 1.0
        share = min(max(sum(counts[p] * post[p] for p in counts) / sum(counts.values()), 0.001), 0.998)
        for side in tables:
            for k in range(m):
                mass = {v: sum(c * (post[p] if side else 1 - post[p]) for p, c in counts.items() if p[k] == v) for v in "+-="}
                total = max(sum(mass.values()), 1e-9)
                mass = {v: min(max(x / total, 0.001), 0.998) for v, x in mass.items()}
                if side:
                    mass["="] = min(mass["="], 0.0005)
                tables[side][k] = {v: x / sum(mass.values()) for v, x in mass.items()}
    return post


def test_op9_verdict(spark):
    """Votes, posteriors and verdicts of a whole table against plain Python; some documents with a vote against them stay."""
    folder = "/root/testdata/sf0.01"
    want = {i: graded(t) for i, t in texts(spark, folder)}
    post = plain_estimate(Counter(v for v, _ in want.values()))
    got = q.op9_quality(spark, folder).collect()
    assert len(got) == len(want)
    for r in got:
        votes, failed = want[r.doc_id]
        assert (r.votes, r.base_failed, r.kept) == (votes, failed, not failed and post[votes] >= 0.5)
        assert math.isclose(r.posterior, post[votes], rel_tol=1e-6, abs_tol=1e-9)
    assert sum(r.kept and "-" in r.votes for r in got) >= 10


def test_op9_kinds_of_junk():
    """Junk that one rule alone sees goes, whichever it is; a weak vote alone counts by how often it meets other votes against."""
    from roomweave.llm import quality

    rules = len(quality.RULES)
    one = lambda k, v: "+" * k + v + "+" * (rules - k - 1)
    for k in range(rules):
        other = (k + 1) % rules
        found = quality.estimate({"+" * rules: 8000, one(k, "="): 200, one(other, "="): 300, one(k, "-"): 400})
        assert found[one(k, "=")] < 0.2 and found[one(other, "=")] < 0.2 and found[one(k, "-")] > 0.8 and found["+" * rules] == 1
    first_two = "--" + "+" * (rules - 2)
    found = quality.estimate({"+" * rules: 8000, first_two: 500, one(0, "-"): 3})
    assert found[first_two] < 0.1
    assert quality.estimate({}) == {} and quality.estimate({"+" * rules: 1})["+" * rules] == 1


def test_op4_low_percent(spark):
    """At 60 percent: a set linked to its hub also links to one that is neither near the hub nor far by its sketch."""
    from roomweave.llm import ngram_join

    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    a, b, c = words("a", 28), words("b", 37), words("c", 35)
    docs = [(i, " ".join([*a, *b, c[i]])) for i in range(35)] + [(100, " ".join(a + b + c)), (101, " ".join(a + c))]
    got = ngram_join.join_ngrams(spark.createDataFrame(docs, "doc_id long, text string"), n=1, percent=60)
    component = linked(docs, 1, 60)
    assert component[101] == 0
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: component[i] for i, _ in docs}


@pytest.mark.parametrize("group", ["unlike", "unlike hub"])
def test_op4_large_group(spark, monkeypatch, group):
    """Of sets near one hub, most pairs that cannot link are not looked at, nor are pairs of sets that link to a set amid them."""
    from roomweave.llm import ngram_join

    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    random = np.random.default_rng(7)
    if group == "unlike":  # each lacks blocks of one text and has words of its own
        blocks, docs = [words(f"b{k}x", 10) for k in range(29)], []
        for i in range(60):
            lacking = set(random.choice(29, 8, replace=False).tolist())
            docs.append((i, " ".join(w for k, b in enumerate(blocks) if k not in lacking for w in b) + " " + " ".join(words(f"own{i}x", 35))))
        docs.append((100, docs[50][1] + " end"))
    else:  # near copies of one text, and one with a passage of other documents, which meets the most of them
        text, passage = words("b", 200), words("p", 60)
        docs = [(i, " ".join(text[: 4 * i] + words(f"own{i}x", 4) + text[4 * i + 4 :])) for i in range(40)]
        docs += [(100 + i, " ".join(passage + words(f"end{i}x", 2))) for i in range(80)] + [(200, " ".join(text + passage))]
    pairs, rest = [], ngram_join._rest

    def counted(items, percent):
        pairs.append(rest(items, percent).count())
        return rest(items, percent)

    monkeypatch.setattr(ngram_join, "_rest", counted)
    got = ngram_join.join_ngrams(spark.createDataFrame(docs, "doc_id long, text string"), n=1, percent=80)
    component = linked(docs, 1, 80)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: component[i] for i, _ in docs}
    assert len(pairs) > 0 and sum(pairs) < 200


def test_op2_odd_pages(spark, tmp_path):
    """Null and empty pages, repeated rows, pages without a host and without names, a column of a clashing name, an empty table."""
    page = "<html><body><div class='top'>Site name</div><div class='b'><p>Own text {0} &amp; more</p></div><div class='end'>All rights</div></body></html>"
    rows = [(i, f"https://h.example/{i}", page.format(i), "x") for i in range(6)] + [(5, "https://h.example/5", page.format(5), "x"), (7, "https://h.example/7", None, "x"), (8, None, "", "x"), (9, None, "<p>alone</p>", "x")]
    schema = "page_id long, url string, html string, host string"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{tmp_path}/a/pages.parquet")
    got = sorted((r.page_id, r.text, r.n_chars) for r in q.op2_html_extraction(spark, f"{tmp_path}/a").collect())
    want = [(i, f"Own text {i} & more") for i in (0, 1, 2, 3, 4, 5, 5)] + [(7, ""), (8, "")]
    assert got[:9] == [(i, t, len(t)) for i, t in want] and len(got) == 10
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/pages.parquet")
    assert q.op2_html_extraction(spark, f"{tmp_path}/b").count() == 0


def words11(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def hits11(docs, tests, size=10):
    """(id, words, hit words, items) of each document, from a dictionary of windows."""
    held = defaultdict(set)
    for i, t in tests:
        w = words11(t)
        m = min(size, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            held[tuple(w[k : k + m])].add(i)
    out = []
    for i, t in docs:
        w, hit, items = words11(t), set(), set()
        for m in {len(p) for p in held}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in held:
                    hit |= set(range(k, k + m))
                    items |= held[tuple(w[k : k + m])]
        out.append((i, len(w), len(hit), sorted(str(x) for x in items if x is not None)))
    return out


def test_op11(spark, folder):
    tests = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = [(i, n, h, len(x), sha(",".join(x)), h > 0) for i, n, h, x in hits11(texts(spark, folder), tests)]
    same(rows(q.op11_decontamination(spark, folder), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), want)


def test_op11_sql(spark, folder):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder.startswith('/tmp') else ''}')")
    want = con.execute(q.oracle_sql()["op11_decontamination"]).fetchall()
    same(rows(q.op11_decontamination(spark, folder), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), want)


def test_op11_shards(spark):
    """Few words, short and long windows, patterns within patterns; shards, each broadcast in turn, give the same; clashing columns stay."""
    import random

    from roomweave.llm import decontaminate

    chance = random.Random(11)
    say = lambda n: " ".join(chance.choice(["a", "ab", "b", "é", "aa", "stretched" * 12]) for _ in range(n))
    docs, tests = [(k, say(chance.randrange(200))) for k in range(60)], [(k, say(chance.randrange(9))) for k in range(50)]
    table = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, n_words int, spans string")
    items = spark.createDataFrame(tests, "item_id long, text string")
    for size, shard_bytes in ((4, 1 << 20), (4, 600), (7, 2000)):
        got = decontaminate.find_passages(table, items, words=size, shard_bytes=shard_bytes).collect()
        want = {r[0]: r for r in hits11(docs, tests, size)}
        assert len(got) == len(docs) and all(r.row.n_words == 7 and r.row.spans == "x" for r in got)
        for r in got:
            assert (r.row.doc_id, r.n_words, r.n_hit, r.items) == want[r.row.doc_id]
            assert sum(s.behind - s.first for s in r.spans) == r.n_hit and all(a.behind < b.first for a, b in zip(r.spans, r.spans[1:]))
    assert decontaminate.find_passages(table.limit(0), items).count() == 0
    assert [r.n_hit for r in decontaminate.find_passages(table, items.limit(0)).collect()] == [0] * len(docs)


def test_op12(spark, folder):
    runs = Counter()
    for i, t in texts(spark, folder):
        for w in re.findall("[A-Za-z\u00C0-\u00FF]+", t):
            w = w.translate(LOWER)
            h = 1 if i is None else zlib.crc32(f"{i}:{w}".encode())
            runs[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    same(rows(q.op12_spelling(spark, folder), "word", "form", "root", "n", "n_near", "form_n"), variants({w: n for w, n in runs.items() if len(w) >= 5 and n >= 3}))


def variants(count, ratio=2):
    """By the words that lack one code point: those that share one in the same place, and those that are one."""
    holes = defaultdict(set)
    for w in count:
        holes[w, -1].add(w)
        for k in range(len(w)):
            holes[w[:k] + w[k + 1 :], k].add(w)
    near = defaultdict(set)
    for (rest, k), some in holes.items():
        for w in some:
            near[w] |= some | (holes.get((rest, -1), set()) if k >= 0 else set())
            for v in some if k < 0 else holes.get((rest, -1), ()):
                near[v] |= some
    form = {}
    for w in count:
        best = min(near[w] - {w}, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= ratio * count[w] else None
    out = []
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w] - {w}), count[form[w]] if form[w] else None))
    return out


def test_op12_words(spark):
    """Edits of every kind on words of few letters, chains of forms, ties, repeated rows, other columns, nulls; any number of parts."""
    import random

    from roomweave.llm import spelling

    chance = random.Random(3)
    count = Counter("".join(chance.choice("abé😀x"[: 2 + k % 4]) for _ in range(chance.randrange(3, 8))) for k in range(400))
    count |= {"chain": 100, "chainn": 40, "chainnn": 20, "chainnnn": 3, "tied1": 9, "tied2": 9, "tied": 4}
    table = spark.createDataFrame([(w, n - 1, "s") for w, n in count.items()] + [(w, 1, "t") for w in count] + [(None, 5, "s"), ("gone", None, "s")], "word string, n long, sig string")
    for parts in (2, 3, 7):
        got = rows(spelling.group_variants(table, parts=parts), "word", "form", "root", "n", "n_near", "form_n")
        assert sorted(map(str, got)) == sorted(map(str, variants(count)))
    assert spelling.group_variants(table.limit(0)).count() == 0
    pairs = spelling.near_pairs(table.where("n IS NOT NULL AND word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")))
    assert pairs.count() == pairs.select("a", "b").distinct().count()


def runs_by_period(words, least=12, repeats=2):
    """(start, length, period) of the runs, period by period: a stretch found before has a smaller one."""
    found, n = {}, len(words)
    for q_ in range(1, n // repeats + 1):
        same = np.flatnonzero(np.array(words[q_:]) == np.array(words[:-q_]))
        for part in np.split(same, np.flatnonzero(np.diff(same) > 1) + 1) if len(same) else []:
            if len(part) + q_ >= max(least, repeats * q_):
                found.setdefault((int(part[0]), len(part) + q_), q_)
    return sorted((s, n, p) for (s, n), p in found.items())


def test_op13(spark, folder):
    want = []
    for i, t in texts(spark, folder):
        w = WORD.findall(t)
        n, h = len(w), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        ids = {}
        found = runs_by_period([ids.setdefault(x, len(ids)) for x in w])
        drop = {k for s, m, p in found for k in range(s + p, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(x for k, x in enumerate(w) if k not in drop))))
    same(rows(q.op13_periodic_runs(spark, folder), "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"), want)


def test_op13_words():
    """Texts of few words, periodic ones, several on end; also words that are Thue-Morse or Fibonacci sequences, with runs within runs."""
    import random

    from roomweave.llm.periodic import runs_of

    chance = random.Random(13)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 200:
        fib.append(fib[-1] + fib[-2])
    sets = [[fib[-1], [k.bit_count() % 2 for k in range(200)], [0] * 200, [k % 2 for k in range(101)]]]
    for _ in range(600):
        sets.append([])
        for _ in range(chance.randrange(4)):
            n, k = chance.randrange(70), chance.randrange(1, 4)
            words = [chance.randrange(k) for _ in range(n)]
            if n > 4 and chance.random() < 0.5:
                p, a = chance.randrange(1, n // 2 + 1), chance.randrange(n - 1)
                words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
            sets[-1].append(words)
    for some in sets:
        least, repeats, at, want = chance.choice([12, 12, 4, 2, 7]), chance.choice([2, 2, 3]), 0, []
        for words in some:
            want += [(s + at, n, p) for s, n, p in runs_by_period(words, least, repeats)]
            at += len(words)
        got = runs_of(np.array(sum(some, []), dtype=np.int64), np.repeat(np.arange(len(some)), [len(x) for x in some]), least, repeats)
        assert list(map(tuple, got.tolist())) == want


def test_op13_columns(spark):
    """Clashing columns stay in the row; repeated rows each give one; an empty table gives none."""
    from roomweave.llm import periodic

    table = spark.createDataFrame([(1, "a b " * 9, "x", 3)] * 2 + [(2, None, "y", 4)], "doc_id long, text string, runs string, n_words int")
    got = periodic.find_runs(table).collect()
    assert sorted((r.row.doc_id, r.row.runs, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == [(1, "x", 18, [(0, 18, 2)], "a b")] * 2 + [(2, "y", 0, [], "")]
    assert periodic.find_runs(table.limit(0)).count() == 0


def test_op8_op10_empty_and_columns(spark, tmp_path):
    """Empty tables; columns named like those of the results; vectors of several lengths, each compared with its own."""
    from roomweave.llm import ann

    vectors = [(50 * k, [float(k), 1.0, 0.5][: 1 + k % 3], k, 0.0, "x") for k in range(9)] + [(50 * k + 1, [1.0, float(k), 2.0][: 1 + k % 3], k, 0.0, "x") for k in range(9)]
    schema = "vec_id long, embedding array<float>, rank int, score double, block string"
    spark.createDataFrame(vectors, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    table = [(r[0], r[1]) for r in vectors]
    want = [row for n in (1, 2, 3) for row in nearest([r for r in table if len(r[1]) == n])]
    got = q.op8_nearest(spark, str(tmp_path))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == sorted(x[:3] for x in want)
    nothing = spark.createDataFrame([], schema)
    assert ann.nearest(nothing, nothing, k=5).count() == 0
    rows = "conv_id long, turn long, role string, text string, turns string, record int, layout string"
    spark.createDataFrame([], rows).write.parquet(f"{tmp_path}/a/conversations.parquet")
    spark.createDataFrame([(1, 0, "user", "a", "t", 1, "l")], rows).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert [r.conv_id for r in q.op10_chat(spark, f"{tmp_path}/a").collect()] == [-7]
    assert sorted((r.conv_id, r.n_turns) for r in q.op10_chat(spark, f"{tmp_path}/b").collect()) == [(-7, 2), (1, 1)]
