"""Raw company files are packed, and hold an entry's own fields only."""

import gzip

from filingloom.plans import source_queries as Q


def test_packed_company_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "work_folder", lambda _: f"file://{tmp_path}")
    rows = Q.read_company_facts(spark, "/root/testdata/sf0.001").count()
    files = list((tmp_path / "facts").glob("part-*"))
    assert 1000 < rows and sum(f.stat().st_size for f in files) < 30 * rows
    told = gzip.decompress(files[0].read_bytes()).decode()
    assert told.startswith('[{"cik":"') and '"end":"' in told and '"ord"' not in told and '"tie"' not in told
