import io
import zipfile

import pandas as pd
import pyarrow as pa
import pyarrow.feather as feather

from factorloom.sources import archives


def packed(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return b.getvalue()


def test_discover_opens_nested_archives_and_reports_errors(spark, tmp_path):
    inner = packed({"SH.600000.CSV": b"datetime,close\n", "deep.ZIP": packed({"000001.SZ.csv": b"a\n"}), "bad.zip": b"no archive", "note.txt": b"x"})
    (tmp_path / "2023.ZIP").write_bytes(packed({"m.zip": inner}))
    (tmp_path / "broken.zip").write_bytes(b"PK nothing")
    (tmp_path / "loose.Csv").write_bytes("代码,收盘\n".encode("gb18030"))
    got = archives.discover_csv(spark, str(tmp_path))
    rows = {r["filename"]: r for r in got.collect()}
    assert set(rows) == {"SH.600000.CSV", "000001.SZ.csv", "bad.zip", "broken.zip", "loose.Csv"}
    assert rows["000001.SZ.csv"]["nested_archive"] == "m.zip:deep.ZIP" and rows["000001.SZ.csv"]["raw_text"] == "a\n"
    assert rows["loose.Csv"]["raw_text"] == "代码,收盘\n" and rows["loose.Csv"]["source_type"] == "directory"
    assert {k for k, r in rows.items() if r["error"]} == {"bad.zip", "broken.zip"}
    assert all((r["raw_text"] is None) == (r["error"] is not None) for r in rows.values())
    done = got.where("filename = 'loose.Csv'").select("file_hash")
    assert archives.discover_csv(spark, str(tmp_path), known=done).where("error is null").count() == 2
    assert archives.discover_csv(spark, str(tmp_path), depth=1).where("error = 'nested too deep'").count() == 2


def test_read_arrow_files_in_tasks(spark, tmp_path):
    t = pd.DataFrame({"a": [1, 2, None], "b": ["x", None, "z"]})
    for i in range(2):
        feather.write_feather(pa.Table.from_pandas(t, preserve_index=False), tmp_path / f"{i}.feather")
    got = archives.read_any(spark, str(tmp_path / "0.feather"))
    assert got.columns == ["a", "b"] and got.count() == 3
