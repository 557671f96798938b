"""Queries over lines against their SQL on lines that the generated tables hardly have."""

import duckdb
import pytest

from verbatile.plans import catalog

LINES = {
    "heading_checks": [
        "ÊAITION.!! ÈÉ!!", "ABC é", "É AB", "chapter came,", "part i,", "Part 2", "part of it,", "Act 2 The Dawn,", "notes: foo,", "Preface,", "glossary - terms,", "ſtory 1,", "booK x,",
        " lower", "Upper, ", "　", " ", "", "Oh\x0bNo!", "Oh\tNo!", "AB\x0bCD", "AB  ", "A" * 17 + " bcd", "A" * 34 + " " + "b" * 6, "A" * 697 + " " + "b" * 123, "12:30…", "'x", "X\r", "x\r", "Section\x0b2,",
    ],
    "noise_lines": [
        "bcdfghjk", "bcdfghjklm", "bcdfghjkl", "bcdyfghjkl", "bcdfghjkyyyyyyyy", "\\\\\\\\\\\\\\\\\\\\\\\\", "####>>>><<<<", "# ###########", "#\x0b###########", " # >>>>>>>>>>", " bcdfghjklmnpqrst ", "　bcdfghjkl",
        "ſſſſſſſſſſ", "K" * 10, "bcdfghjkl\t", "", "a @@#### $$%%%% b", "bcdfghjk aaaaaaa", "bcdfghjk aaaaaa", "BCDFGHJKLM",
    ],
}


@pytest.mark.parametrize("name", sorted(LINES))
def test_odd_lines(spark, tmp_path, name):
    c, key = duckdb.connect(), lambda r: tuple(map(str, r))
    for at in range(0, len(LINES[name]), 8):
        # The n-th line stands 2^n times, so that differences can't make up for each other in counts.
        part = LINES[name][at : at + 8]
        docs = [(n, "\n".join([x] * 2**n)) for n, x in enumerate(part)] + [(101, None), (None, "\n".join([part[0]] * 256))]
        sf_dir = f"{tmp_path}/{at}"
        spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{sf_dir}/documents.parquet")
        c.execute(f"create or replace view documents as select * from '{sf_dir}/documents.parquet/*.parquet'")
        want = c.execute(catalog.ORACLES[name]).fetchall()
        assert sorted((tuple(r) for r in catalog.QUERIES[name](spark, sf_dir).collect()), key=key) == sorted(want, key=key), part
