"""Cross-tokenizer alignment against whole texts and all overlaps."""

import hashlib
import random
from collections import Counter

import pytest

from synthlens.llm import alignment
from synthlens.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = ["Hello, wörld 漢字😀 ﬁ x  z\n\tq <0x41> <s> <unk> é", "a<|endoftext|>b <|endoftext|>", " lead", "trail ", "  two  ",
       "\n", " x  y", "a▁b", "▁", "a ▁ b c", "tab\t \tx \x1c y\x85 z 　w ﻿v ​u", "it's 'll don 't",
       "12 345,6 7.8", "a\u0000b c", "é ñ", "漢" * 300, "x" * 3000, "😀😀 😀", "᠎ q ᠎"]


def plain_tokens():
    """A text's ids and token bytes by both, each over the whole text at once."""
    al = alignment.Aligner(A, B)

    def run(text):
        a = al.a.encode(" " + text, add_special_tokens=False).ids
        b = al.b.encode(text)
        xs, ys = al.bytes[0][a].tolist(), al.bytes[1][b].tolist()
        same = b"".join(xs) == b"".join(ys) == (" " + text).encode()
        return (list(zip(a, xs)), list(zip(b, ys))) if text and same else ([], [])

    return run


def spans(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain(texts):
    run = plain_tokens()
    per_doc, counts = [], Counter()
    for t in texts:
        a, b = map(spans, run(t or ""))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, start = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(x[0]) for x in side if start < x[2] <= c) for side in (a, b)))
            start = c
        counts.update(set(links))
        per_doc.append((a, b, groups, links))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    return [(len(a), len(b), len(g), len(k), sum(counts[x] == most[x[0]] for x in k), sum(counts[x] for x in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, g, k in per_doc]


def got(df, **kw):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted(([r["doc_id"] is None, r["doc_id"] or 0], tuple(r[c] for c in names))
                  for r in alignment.align_documents(df, A, B, **kw).collect())


def want(rows):
    return sorted(([i is None, i or 0], x) for (i, _), x in zip(rows, plain([t for _, t in rows])))


@pytest.mark.parametrize("lookup", [alignment.LOOKUP, 50, 0])
def test_equals_all_overlaps(spark, odd, odd_rows, lookup):
    rows = [(r[0], r[1]) for r in odd_rows if len(r[1] or "") < 9000] + [(100 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pairs", "2 AS rid", "'z' AS n")
    assert got(df, lookup=lookup) == want(rows)


def test_documents(spark, documents, rows_of, no_docs, odd):
    rows = [(i, t) for i, t, _ in rows_of if len(t or "") < 1500]
    df = documents.where("length(text) < 1500 OR text IS NULL")
    assert got(df) == want(rows)
    assert alignment.align_documents(no_docs, A, B).count() == 0
    assert alignment.align_documents(odd, A, B).count() == odd.count()


def test_chunks_equal_whole_texts():
    """Ids of random texts with odd white space and letters, by chunks and at once."""
    rng = random.Random(8)
    letters = list("ab cd  'stll.,12é漢😀\n\t  　\x85\x1c\x1f​᠎﻿́<|>İ")
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(3000)]
    al = alignment.Aligner(A, B)
    run = plain_tokens()
    for t, (sizes, digest, _, _) in zip(texts, alignment.align_texts(texts, al)):
        a, b = run(t)
        assert sizes[:2] == (len(a), len(b))
        ids = [x for g in (al.groups[i] for i in al.numbers([alignment.chunks_of(t)])[0]) for x in g[:-1].split(b";")] if a else []
        assert [int(x) for g in ids for x in g.split(b"|")[0].split(b",")] == [i for i, _ in a]
        assert [int(x) for g in ids for x in g.split(b"|")[1].split(b",")] == [i for i, _ in b]
