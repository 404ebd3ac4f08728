"""Cross-tokenizer alignment against the two libraries and a plain model of the contract."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from usagelens.llm import crosstok

SCHEMA = "doc_id long, text string, block long, p string, n long"


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def plainly(texts, libraries):
    """The rows of the contract without doc_id, by loops over all tokens."""
    one, two = libraries
    to_byte, held, all_links, out = byte_of(), defaultdict(set), [], []
    for at, text in enumerate(texts):
        row, links = [0, 0, 0, ""], []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            bytes_a = [bytes(to_byte[c] for c in one.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                spans = []
                for parts in (bytes_a, bytes_b):
                    ends, end = [], 0
                    for p in parts:
                        ends.append((end, end + len(p)))
                        end += len(p)
                    spans.append(ends)
                j = 0
                for i, (s, e) in enumerate(spans[0]):
                    while spans[1][j][1] <= s:
                        j += 1
                    k = j
                    while k < len(b) and spans[1][k][0] < e:
                        links.append((a[i], b[k]))
                        k += 1
                common = {e for _, e in spans[0]} & {e for _, e in spans[1]}
                told, group_a, group_b, n = [], [], [], 0
                j = 0
                for i, (_, e) in zip(a, spans[0], strict=True):
                    group_a.append(i)
                    if e in common:
                        while True:
                            group_b.append(b[j])
                            j += 1
                            if spans[1][j - 1][1] == e:
                                break
                        told.append(",".join(map(str, group_a)) + "|" + ",".join(map(str, group_b)))
                        group_a, group_b, n = [], [], n + 1
                row = [len(a), len(b), n, hashlib.sha256(";".join(told).encode()).hexdigest()]
        for pair in links:
            held[pair].add(at)
        all_links.append(links)
        out.append(row)
    count = {pair: len(x) for pair, x in held.items()}
    top = Counter()
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    rows = []
    for (n_a, n_b, n_groups, digest), links in zip(out, all_links, strict=True):
        n_best = sum(count[x] == top[x[0]] for x in links)
        rows.append((n_a, n_b, n_groups, len(links), n_best, sum(count[x] for x in links), digest))
    return rows


def odd_texts():
    rng = random.Random(5)
    words = ["The", "naïve", "cafés", "don't", "日本語", "x²", "0x1F600", "e.g.", "https://a.b/c?d=1", "😀👍🏽", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "ʼn", "ﬁ", "\u200b", "Ǿ", "aaaaaaaa", "==>", "\xad"]
    texts = [None, "", " ", "\n", "a", "▁", "a▁b", "x\x00y", "\u00a0", "\t\tif x:\n\t\t\treturn  1\r\n", "  two  spaces ", "end ", " start", "line\n\nline\nend", "\ufffd", "y" * 500, "é" * 300, "<s>"]
    for _ in range(60):
        texts.append(rng.choice(["", " ", "\n"]).join([""] * 1) + rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randrange(1, 30))))
    for _ in range(60):
        texts.append("".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(128, 0x800), rng.randrange(0x2000, 0x2800), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(1, 60))))
    texts.append(" ".join(rng.choice(words) + str(i % 89) for i in range(5000)))
    texts += ["word " * 300 + "é" * 1200, " " * 1100 + "x" * 3000, "a\n" * 600 + "\t" * 1500 + "b", "ab" * 5000]  # pieces that the other encoder takes
    return texts + texts[9:12]


def test_gallop():
    rng = random.Random(1)
    for _ in range(300):
        long = sorted(rng.sample(range(1, 400), rng.randrange(1, 200)))
        short = sorted({*rng.sample(range(1, long[-1] + 1), min(long[-1], rng.randrange(1, 30))), long[-1]})
        assert crosstok.gallop(short, long) == [bisect_left(long, x) for x in short]


def test_against_the_libraries(spark, libraries, monkeypatch):
    monkeypatch.setattr(crosstok, "HELD", 3000)  # several blocks to a task
    monkeypatch.setattr(crosstok, "ROW", 100)
    texts = odd_texts()
    rows = [(i // 2 if i % 7 else None, t, 1, "p", 2) for i, t in enumerate(texts)]
    got = crosstok.align(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = [(r[0], *x) for r, x in zip(rows, plainly(texts, libraries), strict=True)]
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x) for x in r))
    assert order(map(tuple, got)) == order(want)
    assert sum(r[1] > 0 for r in want) > 100


def test_groups_give_the_text_back(spark, libraries):
    one, two = libraries
    rows = [(i, t, 1, "p", 2) for i, t in enumerate(["One line.\nAnd another, naïve one", None, "<|endoftext|> plain"])]
    got = {r.doc_id: r.groups for r in crosstok.groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == []
    for i in (0, 2):
        assert [x for g in got[i] for x in g.a] == one.encode(" " + rows[i][1], add_special_tokens=False).ids
        assert [x for g in got[i] for x in g.b] == two.encode(rows[i][1])
        assert all(one.decode(g.a, skip_special_tokens=False).encode("utf-8", "replace") for g in got[i])


def test_empty_table(spark):
    assert crosstok.align(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_on_whole_documents(spark, libraries):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = [(d.doc_id, *x) for d, x in zip(docs, plainly([d.text for d in docs], libraries), strict=True)]
    assert sorted(map(tuple, crosstok.op12(spark, sf).collect())) == sorted(want)
