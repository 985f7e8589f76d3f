"""Digests of whole files, read as lines in many splits."""

import gzip
import hashlib
import random

from namesieve.sources.fingerprints import file_fingerprints, list_fingerprint


def test_digests_equal_hashlib(spark, tmp_path):
    rng = random.Random(2)
    files = {
        "binary.bin": rng.randbytes(50_000), "no break": b"x" * 9000, "ends.txt": b"a\r\nb\n\n", "open.txt": b"\n\na\rb",
        "mark.txt": b"\xef\xbb\xbfa\nb", "marked.txt": b"\xef\xbb\xbfa\n", "sub/many.csv": b"row,of,cells\n" * 20_000, "packed.gz": gzip.compress(b"a\nb\n"), "feeds": b"\n" * 77,
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content)
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "5000")  # files larger than what one task reads
    try:
        rows = file_fingerprints(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(setting, before)
    got = {r.path.split(f"{tmp_path}/")[1].replace("%20", " "): (r.length, r.file_sha256) for r in rows}
    assert got == {name: (len(c), hashlib.sha256(c).hexdigest()) for name, c in files.items()}
    one = hashlib.sha256(files["sub/many.csv"]).hexdigest()
    assert list_fingerprint(spark, str(tmp_path / "sub")) == one
