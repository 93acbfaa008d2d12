"""Cards do not depend on where a file is cut, or on its name."""

import pytest

from passagemill.operators.cards import csv_cards
from passagemill.sources.csvfiles import scan_csv
from passagemill.sources.rawfiles import list_files

ROWS = [f'{n},"a ""q"" {n}",x{n}' for n in range(12)]
SURPLUS = {f"surplus {n}.csv": ("a,b,c\n" + "\n".join(r + (",more" if i == n else "") for i, r in enumerate(ROWS)) + "\n").encode() for n in range(0, 12, 3)}
BYTES = {f"_bad {n}.csv": ("a,b,c\n" + "\n".join(ROWS[:n]) + "\n").encode() + b"1,\xff,2\n" + ("\n".join(ROWS[n:]) + "\n").encode() for n in (0, 5, 12)}
TABLES = {
    **SURPLUS, **BYTES, "größe (1).csv": ("a,b,c\n" + "\n".join(ROWS)).encode(), ".hidden.csv": b"a\r\n1\r\n\r\n2\r\n",
    "big.csv": b"id,u,over,real\n1234567890123456789,18446744073709551615,99999999999999999999,1\n-5,0,1,2.5\n",
    "breaks.csv": b'k,v\n' + b"".join(b'%d,"l\r\n%d"\r\n' % (n, n) for n in range(20)), "stray.csv": b'k,v\n1,5" pipe\n2,"x\n""y"\n3,z"q\n4,"t"u\n',
    "labels.csv": b"a,b\n0,1,2\n1,3,4\n", "names.csv": b",a,a\n1,2,3\n", "short.csv": b"a,b,c\n1\n2,3\n", "empty.csv": b"", "one": b"",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    for name, data in TABLES.items():
        (root / name).write_bytes(data)
    return list_files(spark, str(root)).where("path LIKE '%.csv'").persist()


def cards(files, **options):
    return {r.path.rsplit("/", 1)[-1]: r.content for r in csv_cards(files, **options).collect()}


@pytest.mark.parametrize("split_bytes", [1, 17, 64])
def test_cards_are_the_same_at_any_range_size(files, split_bytes):
    assert cards(files, split_bytes=split_bytes) == cards(files)


def test_cards_of_odd_tables(files):
    got = cards(files)
    assert len(got) == len(TABLES) - 1
    # A surplus cell in the first record means row labels, and then the others are short; elsewhere it is an error.
    assert [bool(got[name]) for name in SURPLUS] == [True, False, False, False]
    assert not any(got[name] for name in BYTES) and got["empty.csv"] == ""
    assert "Number of rows: 12" in got["größe (1).csv"] and 'b: a "q" 0' in got["größe (1).csv"]
    assert "Number of rows: 2" in got[".hidden.csv"]
    assert "Row 1: id: 1234567890123456789 | u: 18446744073709551615 | over: 99999999999999999999 | real: 1.0" in got["big.csv"]
    assert "Number of rows: 20" in got["breaks.csv"]
    assert "Number of rows: 4" in got["stray.csv"] and 'v: 5" pipe' in got["stray.csv"] and "v: tu" in got["stray.csv"]
    assert "Row 2: a: 3 | b: 4" in got["labels.csv"]
    assert "Columns: Unnamed: 0, a, a.1" in got["names.csv"]
    assert "Row 1: a: 1 | b: nan | c: nan" in got["short.csv"]


def test_scan_csv_reads_line_breaks_where_there_are_any(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"u\nv"\n')
    (tmp_path / "b.csv").write_text("x,y\n1,u\n2,w\n")
    assert [tuple(r)[:2] for r in scan_csv(spark, [str(tmp_path / "a.csv")]).collect()] == [(1, "u\nv")]
    assert scan_csv(spark, [str(tmp_path / "b.csv")]).count() == 2


@pytest.mark.parametrize("split_bytes", [1, 17, 1 << 20])
def test_rows_and_cards_agree_on_every_table(spark, files, split_bytes):
    """A surplus cell or bad byte anywhere, odd quotes, labels, short rows: both read the file, or neither does."""
    readable = cards(files)
    for path in sorted(r.path for r in files.collect()):
        name = path.rsplit("/", 1)[-1]
        rows = scan_csv(spark, path, split_bytes=split_bytes)
        if not readable[name]:
            assert rows.columns == ["source_path"] and rows.count() == 0
            continue
        lines = readable[name].split("\n")
        count = int(next(x for x in lines if x.startswith("Number of rows: ")).split(": ")[1])
        assert rows.count() == count, name
        assert "Columns: " + ", ".join(rows.columns[:-1]) == lines[1]
    big = scan_csv(spark, str(next(r.path for r in files.collect() if r.path.endswith("/big.csv"))), split_bytes=split_bytes)
    assert dict(big.dtypes)["id"] == "bigint" and dict(big.dtypes)["u"] == "decimal(20,0)" and dict(big.dtypes)["over"] == "string"
    assert {(r.id, int(r.u), r.over, r.real) for r in big.collect()} == {(1234567890123456789, 18446744073709551615, "99999999999999999999", 1.0), (-5, 0, "1", 2.5)}


def test_no_cell_is_lost(spark, tmp_path):
    (tmp_path / "surplus.csv").write_text("n,k\n1,x\n2,y,SURPLUS\n")
    (tmp_path / "good.csv").write_text("n,k\n1.5,NA\n,z\n7\n")
    (tmp_path / ".hidden.csv").write_text("n,k\n9,q\n")
    got = scan_csv(spark, str(tmp_path)).collect()
    assert {(r.n, r.k) for r in got} == {(1.5, None), (None, "z"), (7.0, None)}
    assert {r.source_path.rsplit("/", 1)[-1] for r in got} == {"good.csv"}
    (tmp_path / "other.csv").write_text("n,m\n1,x\n")
    with pytest.raises(ValueError, match="different headers"):
        scan_csv(spark, str(tmp_path))
