"""The manifest query sees every file, and large files are digested in pieces."""

import hashlib
import os

from regioscope import catalogue
from regioscope.plans import pages  # noqa: F401
from regioscope.sources import files

SF = "/root/testdata/sf0.001"


def test_every_table_has_a_status(spark):
    got = {r.name: r.status for r in catalogue.QUERIES["manifest_verify"](spark, SF).collect()}
    want = dict.fromkeys(os.listdir(SF), "ok") | {"absent.parquet": "missing"}
    want |= dict.fromkeys(("nation.parquet", "documents.parquet"), "mismatch") | dict.fromkeys(("region.parquet", "orders.parquet"), "unlisted")
    assert got == want and len(got) == 15


def test_large_and_nested_files(spark, tmp_path):
    body = {"a.pdf": b"%PDF" + b"x" * 5000, "t.parquet/part-0.parquet": b"PAR1" + b"y" * 3000, "u.parquet/part-0.parquet": b"no", "e.bin": b""}
    for name, data in body.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    want = {(n, len(d), hashlib.sha256(d).hexdigest(), None if n == "e.bin" else d[:1] in (b"%", b"P")) for n, d in body.items()}
    for whole in (256 << 20, 1000, 0):
        assert {tuple(r) for r in files.scan(spark, str(tmp_path), whole=whole).collect()} == want
