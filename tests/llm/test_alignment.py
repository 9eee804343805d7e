"""Alignment of two tokenizers against a plain version that looks at every pair of tokens."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marlstone.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox.", "The quick brown fox.", "", None, "a  b\n\n c\t\td \n", "<|endoftext|> </s> <0x41> <unk>", "naïve café ÀÉ ×÷ œuvre", "日本語のテキスト and 漢字", "x▁y", "🙂 emoji 🙃🙃", " leading", "trailing ", " ", "\n", "  nbsp  em  　 wide",
    "don't we'll they're", "a" * 3000, "12345 678.90 !!!???", "nul\0in", "\r\nlines\r\nof text;\r\n",
    "the cat sat on the mat because the dog did not " * 40,
]


def plain(rows):
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    out, counts = [], Counter()
    for doc, text in rows:
        said = (" " + (text or "")).encode()
        left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(said.decode(), add_special_tokens=False).ids] if text else []
        right = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)] if text else []
        if b"".join(x for _, x in left) != said or b"".join(x for _, x in right) != said:
            out.append((doc, 0, 0, 0, [], ""))
            continue

        def spans(tokens):
            at, found = 0, []
            for i, x in tokens:
                found.append((at, at + len(x), i))
                at += len(x)
            return found

        left, right = spans(left), spans(right)
        links = [(i, k) for s, e, i in left for u, v, k in right if s < v and u < e]
        ends, begin, groups = sorted({e for _, e, _ in left} & {v for _, v, _ in right}), 0, []
        for end in ends:
            groups.append("|".join(",".join(str(i) for _, e, i in side if begin < e <= end) for side in (left, right)))
            begin = end
        counts.update(set(links))
        out.append((doc, len(left), len(right), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return sorted(((d, na, nb, ng, len(ls), sum(counts[x] == best[x[0]] for x in ls), sum(counts[x] for x in ls), sha) for d, na, nb, ng, ls, sha in out), key=repr)


@pytest.mark.parametrize("mapped", [True, False])
def test_same_as_plain(spark, docs, mapped):
    df = docs(*TEXTS, extra=("n_a", "key", "links")).repartition(3)
    want = plain(enumerate(TEXTS))
    for rows in (2, 1 << 21):  # many shards, and one
        got = sorted(map(tuple, alignment.align(df, *PATHS, shard_rows=rows, mapped=mapped).collect()), key=repr)
        assert got == want
    assert sum(r[1] == 0 for r in want) == 3  # null, empty, and the sign that B writes spaces with


def test_segments_are_independent():
    of = alignment.Aligner(*PATHS)
    assert of.cuts and of.fast
    text = "One two,  three\n\nfour \té è  five. Über straße"
    cut = [s.decode() for s in of.segments(text.encode())]
    assert "".join(cut) == " " + text and len(cut) > 6
    assert sum(of.encode_b(cut), []) == of.b.encode(text)
    assert sum(of.encode_a(cut), []) == of.a.encode(" " + text, add_special_tokens=False).ids


def test_cache_is_cleared(spark, docs, monkeypatch):
    of = alignment.Aligner(*PATHS)
    first = of.numbers([b"one two", None, b""])
    assert first[1].tolist() == [0, 2, 2, 2]
    monkeypatch.setattr(alignment, "CACHED", 1)
    again = of.numbers([b"two one"])[0]
    assert len(of.known) == 2 and again.tolist() == [0, 1]


def test_counts_are_flushed(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "PENDING", 1)
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(["ab cd", "ab cd", "ef"])], names=["doc_id", "text"])
    rows = pa.Table.from_batches(list(alignment.link_rows(PATHS)(iter([batch]))))
    whole = rows.filter(rows.column("counted"))
    assert sum(whole.column("n").to_pylist()) == sum(len(set(alignment.unpacked(x).tolist())) for x in rows.column("links").to_pylist() if x is not None)


def test_empty_table_and_repeats(spark, docs):
    assert alignment.align(docs(), *PATHS).collect() == []
    got = alignment.align(docs("one two", "one two", "three", ids=[4, 4, None]), *PATHS).collect()
    assert sorted((r["doc_id"] is None, r["count_sum"] > 0) for r in got) == [(False, True), (False, True), (True, True)]


def test_remote_folders_are_not_mapped():
    assert alignment.mounted("file:///a/b") == "/a/b" and alignment.mounted("/a") == "/a" and alignment.mounted("hdfs://x/a") is None
