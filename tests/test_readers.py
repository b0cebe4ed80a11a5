import csv
import gzip

import pytest
from duelgrid.sources import readers as R


def write(path, header, rows, opener=open):
    with opener(path, "wt", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)


HEADERS = [R.COMPETITOR_TEXT, R.PATCH_TEXT, R.MERGE_TEXT, R.OUTSIDE_NAMED_TEXT, R.OUTSIDE_LINKED_TEXT, R.BOOK_TEXT, R.UPCOMING_TEXT, R.MEDIA_TEXT,
           R.PHOTO_TEXT, R.ALIAS_TEXT, R.RAW_RESULT_TEXT, R.RAW_ROUND_TEXT, R.RAW_EVENT_TEXT, R.RAW_PHYSICAL_TEXT, R.PRICE_TEXT]


@pytest.mark.parametrize("header", HEADERS)
def test_columns_come_by_each_files_own_header(spark, tmp_path, header):
    cell = lambda c, n: f'{c}, "{n}"\nline'
    write(tmp_path / "a.csv", header, [[cell(c, 1) for c in header]])
    other = [*reversed(header), "One more"]
    write(tmp_path / "b.csv", other, [[cell(c, 2) for c in other]])
    write(tmp_path / "c.csv.gz", ["﻿" + header[0], *header[2:]], [[cell(c, 3) for c in (header[0], *header[2:])]], gzip.open)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "_hidden.csv").write_text("x,y\n1,2\n")
    got = R.read_text_table(spark, str(tmp_path), header)
    assert got.columns == list(header)
    want = [tuple(None if (n == 3 and c == header[1]) else cell(c, n) for c in header) for n in (1, 2, 3)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_an_opening_price_is_no_closing_price(spark, tmp_path):
    (tmp_path / "books.csv").write_text("date,event_slug,fighter1,fighter2,open1,open2,close1,close2,n_books\n2001-01-02,e,A,B,1.5,2.5,1.6,2.4,7\n")
    row = R.book_source(R.read_text_table(spark, str(tmp_path / "books.csv"), R.BOOK_TEXT)).first()
    assert (row.open1, row.open2, row.close1, row.close2, row.n_books) == (1.5, 2.5, 1.6, 2.4, 7)


def test_upcoming_file_as_it_is(spark, tmp_path):
    (tmp_path / "u.csv").write_text(",".join(R.UPCOMING_TEXT) + "\n9,Night,2001-09-01,2,1,Lightweight,a1,Ann,77,,Bea,,now\n")
    row = R.upcoming_source(R.read_optional(spark, str(tmp_path / "u.csv"), R.UPCOMING_TEXT)).first()
    assert (row.division, row.main_event, row.c1, row.foreign1, row.c2, row.foreign2) == ("Lightweight", True, "a1", "77", None, None)


def test_repeated_header_names_and_absent_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("source,normalized_name,source,canonical_id\nfirst,n,second,1\n\n")
    assert [tuple(r) for r in R.read_text_table(spark, str(tmp_path / "a.csv"), R.ALIAS_TEXT).collect()] == [("n", "first", "1")]
    assert R.read_optional(spark, str(tmp_path / "none.csv"), R.ALIAS_TEXT).count() == 0
    assert R.read_text_table(spark, str(tmp_path / "none*.csv"), R.ALIAS_TEXT).columns == list(R.ALIAS_TEXT)


def test_prices_keep_the_id_of_their_file(spark):
    """The id was left out of the read, so rows alike but for it could not be told apart."""
    columns = ("price_id", *R.PRICE_TEXT)
    row = ("2001-02-03", "e", "A", "B", "1.5", "2.5", "FAVOURITE")
    raw = spark.createDataFrame([("7", *row), ("8", *row), ("9", *row[:5], "n/a", "UNDERDOG")], ", ".join(f"{c} string" for c in columns))
    assert sorted((r.price_id, r.outcome) for r in R.price_source(raw).collect()) == [(7, "favourite"), (8, "favourite")]
    assert R.price_source(raw.drop("price_id")).columns[0] == "date"
