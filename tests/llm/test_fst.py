import numpy as np
import public_tokenizers as P
import pyarrow as pa
import regex
from test_tokens import texts
from tokenizers import Tokenizer

from sablegrid.llm import flat, fst


def test_chunk_maps_find_the_boundaries_of_the_pattern():
    given = [t for t in texts() if t is not None]
    column = flat.Texts(given)
    begins = np.flatnonzero(fst.piece_boundaries(column)[: column.size])
    pattern, expected = regex.compile(P.PATTERN), []
    for text, base in zip(given, column.offsets, strict=False):
        expected += [base + len(text[: m.start()].encode()) for m in pattern.finditer(text)]
    assert begins.tolist() == expected


def test_counts_equal_library(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens").repartition(4)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = {r.doc_id: r for r in fst.count_tokens(df, P.path("byte_bpe_50k.json")).collect()}
    for i, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (found[i].n_tokens, found[i].n_bytes, found[i].over_limit) == (n, len((text or "").encode()), n > 512)
    assert fst.count_tokens(df.limit(0), P.path("byte_bpe_50k.json")).collect() == []


def test_merges_across_borders_by_definition():
    transducer = fst.MergeTransducer(P.path("byte_bpe_50k.json"))
    words = ["aaa", "aaaaaa", "ababab", "hello", "unbelievable", "éé", "  x", "0000000"]
    assert transducer.counts(pa.array(words)).tolist() == [sum(len(transducer.encode(p.encode())) for p in regex.findall(P.PATTERN, w)) for w in words]
