import io
import zipfile

import pytest
from shardmend.functions import bytesio as b
from shardmend.functions import corpus
from shardmend.operators import detect, recover

MEMBERS = [(f"m{k}.txt", f"member {k} ".encode() * 60) for k in range(6)]
CLEAN = {"zip": b.build_zip(MEMBERS), "tar": b.build_tar(MEMBERS), "gzip": b.build_gzip(b"payload " * 900), "iso9660": corpus.build_iso(), "pdf": corpus.build_pdf("text"), "sqlite": corpus.build_sqlite()}


def test_clean_builders_are_clean():
    for fmt, data in CLEAN.items():
        assert list(detect.findings_of(fmt, data)) == [], fmt
    for kind in ("docx", "xlsx", "pptx"):
        assert zipfile.ZipFile(io.BytesIO(corpus.build_opc(kind, "t"))).testzip() is None


@pytest.mark.parametrize("name", corpus.MUTATORS)
def test_mutators(name):
    fmt, _ = corpus.MUTATORS[name]
    for f, data in CLEAN.items():
        if fmt in ("*", f):
            bad = corpus.mutate(name, data, 7, f"{name}/{f}")
            assert bad == corpus.mutate(name, data, 7, f"{name}/{f}")
            rules = [x[0] for x in detect.findings_of(f, bad)]
            if name in corpus.EXPECTED:
                assert set(corpus.EXPECTED[name]) & set(rules), (name, rules)
            # whatever the damage, nothing that a repair makes verifies bytes that were not there
            for strategy in recover.APPLY.values():
                made = strategy(bad)
                if made and f == "zip":
                    for e in b.parse_zip(made[0]).central:
                        status, body, _ = b.extract_zip(made[0], e)
                        assert status != "VERIFIED_CRC" or body in {x for _, x in MEMBERS}
