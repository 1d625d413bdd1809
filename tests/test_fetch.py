"""Resumable fetch over a local server that breaks off, and bounded work ahead."""

import hashlib
import http.server
import random
import threading
import time
from pathlib import Path

import pytest

from tagloom.sources import ahead, fetch, store, tars
from sources_helpers import latent_tar, png, write_tar


class Server(http.server.BaseHTTPRequestHandler):
    files, asked, breaks, ranges = {}, [], 0, True

    def do_GET(self):
        body = self.files.get(self.path)
        wanted = self.headers.get("Range")
        type(self).asked.append((self.path, wanted))
        if self.path.startswith("/secret"):
            self.send_error(403)
            return
        if body is None:
            self.send_error(404)
            return
        start, stop = 0, len(body)
        if wanted and self.ranges:
            a, b = wanted.removeprefix("bytes=").split("-")
            start, stop = int(a), min(len(body), int(b) + 1 if b else len(body))
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {start}-{stop - 1}/{len(body)}")
        else:
            self.send_response(200)
        self.send_header("Content-Length", str(stop - start))
        self.end_headers()
        cls = type(self)
        if cls.breaks and stop - start > 5000:
            cls.breaks -= 1
            stop = start + 3000  # the rest never comes
            self.close_connection = True
        self.wfile.write(body[start:stop])

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    Server.files, Server.asked, Server.breaks, Server.ranges = {}, [], 0, True
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


HOW = fetch.Transfer(tries=4, wait=0.01, timeout=5)


def body(n, seed=1):
    return random.Random(seed).randbytes(n)


def sources(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "source string")


def test_segments_of_a_broken_connection_make_the_file(spark, server, tmp_path):
    Server.files = {"/a.tar": body(100_001), "/b/c.tar?x": body(7, 2), "/empty.tar": b""}
    Server.breaks = 3
    cache = f"file://{tmp_path}/cache"
    names = [f"{server}{p}" for p in Server.files]
    got = {r["source"]: r for r in fetch.fetch(spark, sources(spark, *names, names[0], None), cache, HOW, segment=16_384).collect()}
    assert set(got) == set(names)
    for path, content in Server.files.items():
        r = got[server + path]
        assert Path(r["path"].removeprefix("file://")).read_bytes() == content and r["nbytes"] == len(content)
    url = names[0]
    assert got[url]["path"].endswith(f"/{hashlib.sha1(url.encode()).hexdigest()[:16]}-a.tar") and got[url]["segments"] == got[url]["fetched"] == 7
    asked = [int(w.removeprefix("bytes=").split("-")[0]) for p, w in Server.asked if p == "/a.tar"]
    assert any(a % 16_384 == 3000 for a in asked)  # went on behind the last byte
    Server.asked.clear()
    again = fetch.fetch(spark, sources(spark, *names), cache, HOW).collect()
    assert not Server.asked and all(r["fetched"] == 0 for r in again)
    assert sorted(p.name for p in (tmp_path / "cache").iterdir() if not p.name.startswith(".")) == sorted(r["path"].rpartition("/")[2] for r in again)


def test_a_stopped_job_goes_on_with_what_is_missing(spark, server, tmp_path):
    Server.files = {"/a.tar": body(200_000)}
    cache = f"file://{tmp_path}/cache"
    with pytest.raises(Exception, match="stopped on purpose"):
        fetch.fetch(spark, sources(spark, f"{server}/a.tar"), cache, HOW, segment=1000, fail_after=5)
    parts = next((tmp_path / "cache").glob("*.parts"))
    held = len([p for p in parts.iterdir() if not p.name.endswith(".tmp")])
    assert held > 0 and not list((tmp_path / "cache").glob("*.tar"))
    r = fetch.fetch(spark, sources(spark, f"{server}/a.tar"), cache, HOW, segment=1000).collect()[0]
    assert 0 < r["fetched"] <= 200 - held and Path(r["path"].removeprefix("file://")).read_bytes() == Server.files["/a.tar"]
    assert not parts.exists()


def test_without_ranges_the_whole_file_is_taken(spark, server, tmp_path):
    Server.files, Server.ranges, Server.breaks = {"/a.tar": body(50_000)}, False, 1
    r = fetch.fetch(spark, sources(spark, f"{server}/a.tar"), f"file://{tmp_path}/c", HOW, segment=1000).collect()[0]
    assert (r["nbytes"], r["segments"]) == (50_000, 1)
    assert HOW.one(f"{server}/a.tar", f"file://{tmp_path}/d", "x") == f"file://{tmp_path}/d/x"


def test_refusals_and_absent_files(spark, server, tmp_path):
    Server.files = {}
    with pytest.raises(PermissionError):
        HOW.probe(f"{server}/secret.tar")
    assert len(Server.asked) == 1  # a refusal isn't tried again
    with pytest.raises(OSError):
        HOW.probe(f"{server}/none.tar")
    assert len(Server.asked) == 5
    with pytest.raises(Exception, match="neither an address nor a file"):
        fetch.fetch(spark, sources(spark, f"{tmp_path}/none.tar"), f"file://{tmp_path}/c", HOW).collect()
    with pytest.raises(Exception, match="not a shard of the hub"):
        fetch.fetch(spark, sources(spark, "hf://broken"), f"file://{tmp_path}/c", HOW).collect()


def test_only_the_hub_sees_the_token():
    assert fetch.headers("https://huggingface.co/x", token="t")["Authorization"] == "Bearer t"
    assert fetch.headers("https://cdn.huggingface.co/x", 5, 9, "t") == {"User-Agent": "shard-fetch", "Range": "bytes=5-8", "Authorization": "Bearer t"}
    for url in ("https://huggingface.co.evil.org/x", "https://nothuggingface.co/x", "https://x.org/huggingface.co"):
        assert "Authorization" not in fetch.headers(url, token="t")
    assert fetch.response_total("bytes 5-9/77", "5", 5, 206) == 77
    assert fetch.response_total(None, "5", 5, 206) == 10 and fetch.response_total("bytes 0-1/*", "5", 5, 200) == 5
    assert fetch.response_total(None, "x", 0, 200) is None


def test_both_disk_limits_cover_the_whole_cache(spark, server, tmp_path):
    Server.files = {"/a.tar": body(9000), "/b.tar": body(8000)}
    cache = f"file://{tmp_path}/c"
    fetch.fetch(spark, sources(spark, f"{server}/a.tar"), cache, HOW, most=9000).collect()
    Server.asked.clear()
    with pytest.raises(OSError, match="go beyond"):
        fetch.fetch(spark, sources(spark, f"{server}/b.tar"), cache, HOW, most=16_000)
    assert all(w == "bytes=0-" for _, w in Server.asked)  # only asked for its size
    fetch.fetch(spark, sources(spark, f"{server}/b.tar"), cache, HOW, most=17_000).collect()
    with pytest.raises(OSError, match="free"):
        fetch.check_room(spark, cache, 1, least_free=1 << 60)


def test_files_in_flight_keep_order_and_number():
    held, most_held, lock = set(), [0], threading.Lock()

    def get(x):
        with lock:
            held.add(x)
            most_held[0] = max(most_held[0], len(held))
        time.sleep(0.002 * (5 - x % 5))
        return x

    assert list(ahead.in_flight(range(20), get, 3, held.discard)) == list(range(20))
    assert most_held[0] <= 3 and not held
    it = ahead.in_flight(range(20), get, 3, held.discard)
    next(it)
    it.close()
    assert not held

    def fails(x):
        if x == 2:
            raise ValueError("two")
        return get(x)

    seen = []
    with pytest.raises(ValueError, match="two"):
        for x in ahead.in_flight(range(9), fails, 3, held.discard):
            seen.append(x)
    assert seen == [0, 1] and not held
    with pytest.raises(ValueError):
        next(ahead.in_flight([], get, 0))


def test_items_decoded_ahead_are_bounded_and_pass_errors_on():
    made = []

    def items(n, bad=None):
        for i in range(n):
            if i == bad:
                raise OSError("bad item")
            made.append(i)
            yield i

    it = ahead.decoded(items(1000), 4)
    assert next(it) == 0
    time.sleep(0.1)
    assert len(made) <= 7
    it.close()
    n = len(made)
    time.sleep(0.1)
    assert len(made) == n
    assert list(ahead.decoded(items(50), 4)) == list(range(50)) == list(ahead.decoded(items(50), 0))
    seen = []
    with pytest.raises(OSError, match="bad item"):
        for x in ahead.decoded(items(9, bad=3), 2):
            seen.append(x)
    assert seen == [0, 1, 2]


def test_a_reader_fetches_ahead_and_leaves_nothing(spark, server, tmp_path):
    plain = []
    for i in range(5):
        plain.append(write_tar(tmp_path / f"{i}.tar", [(f"d/{i}{k}.png", png(8, k + 1)) for k in range(3)]))
        Server.files[f"/{i}.tar"] = Path(plain[-1]).read_bytes()
    cache = f"file://{tmp_path}/cache"
    store.write_text(spark, f"{cache}/keep.txt", "mine")
    got = tars.members(spark, [f"{server}/{i}.tar" for i in range(5)], cache=cache, shards_per_task=3, ahead=2, decode=4, wait=0.01)
    key = ("shard_index", "member_ord", "name", "payload")
    assert got.select(*key).orderBy(*key[:2]).collect() == tars.members(spark, plain).select(*key).orderBy(*key[:2]).collect()
    assert got.rdd.getNumPartitions() == 2
    assert [p.name for p in (tmp_path / "cache").iterdir() if not p.name.startswith(".")] == ["keep.txt"]
    latents = latent_tar(tmp_path / "l.tar", 3)
    Server.files["/l.tar"] = Path(latents).read_bytes()
    read = spark.read.format("latent_tar").option("cache", cache).option("shards", tars.listed(spark, [f"{server}/l.tar"])).load()
    assert [r["sample_id"] for r in read.orderBy("sample_ord").collect()] == ["s0", "s1", "s2"]
