"""WARC files: round trip, determinism, rolling, revisits, leftovers."""

import hashlib
import random

from shotlake.llm import warc
from shotlake.llm.shared import fresh_path


def rows():
    rng = random.Random(4)
    page = lambda n: "".join(rng.choice("abc<>é \r\n") for _ in range(n))
    same = page(3000)
    out = [(i, f"http://x.example/{i}", page(rng.randrange(4000))) for i in range(80)]
    out += [(100 + i, f"http://y.example/ü {i}\r\nX: 1", same) for i in range(40)]
    out += [(200, "u", "small"), (201, "u", "small"), (202, None, None), (203, "u", ""), (None, "n", same), (204, "d", same), (204, "d", same)]
    return out


def want(data):
    first = {}
    for i, _, t in data:
        b = (t or "").encode()
        if len(b) >= 1000 and i is not None:
            first[b] = max(first.get(b, i), i)
    out = []
    for i, _, t in data:
        b = (t or "").encode()
        revisit = b in first and first[b] != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1) for r in data], "page_id long, url string, html string, payload int")
    digests = []
    for parts in (3, 5):
        path = fresh_path(spark, "warc-test")
        manifest = warc.write_archives(df.repartition(parts), path, shard_bytes=20_000, file_bytes=4_000)
        files = sorted(tuple(r) for r in manifest.collect())
        assert len({f[0] for f in files}) > 3 and any(f[1] for f in files)
        digests.append(files)
        back = warc.read_archives(spark, path)
        assert got(back) == want(data)
        texts = {(r.page_id, bytes(r.payload).decode()) for r in back.where("record_type = 'response'").collect()}
        assert texts <= {(i, t or "") for i, _, t in data}
        # a file that the manifest doesn't list is not read
        name = path.removeprefix("file://")
        with open(f"{name}/999999-0000.warc.gz", "wb") as f:
            f.write(b"junk")
        assert warc.read_archives(spark, path).count() == len(data)
    assert digests[0] == digests[1]
    assert got(warc.round_trip(df.limit(0))) == []


def test_damage():
    good = warc.member(warc.record(1, "http://a/", b"text", 4, hashlib.sha1(b"text").hexdigest(), None))
    assert len(list(warc.parse(good + good))) == 2
    for bad in (good[:-9], warc.member(warc.record(1, "http://a/", b"text", 4, hashlib.sha1(b"text").hexdigest(), None).replace(b"text\r\n\r\n", b"tixt\r\n\r\n"))):
        try:
            list(warc.parse(bad))
        except ValueError:
            continue
        raise AssertionError
