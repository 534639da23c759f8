"""Archives read by members and ranges, against Python's own readers."""

import io
import json
import random
import tarfile
import zipfile

import pytest

from plumbline.sources.archives import archive_lines, records_of


def texts():
    r = random.Random(1)
    out = {f"posts/day{d}.jsonl": "".join(json.dumps({"post_id": d * 1000 + k, "user_id": r.randrange(40), "text": "é" * r.randrange(30)}, ensure_ascii=False) + "\n" for k in range(300)) for d in range(4)}
    out["accounts.jsonl"] = "".join(json.dumps({"user_id": k, "label": k % 2}) + "\n" for k in range(40))
    out["empty.jsonl"], out["no-end.txt"], out["lines.txt"] = "", "one\n\ntwo\r\nthree", "\n" * 50
    return out


def wanted(files):
    return sorted((m, line.rstrip("\r")) for m, t in files.items() for line in (t[:-1] if t.endswith("\n") else t).split("\n") if t)


@pytest.fixture(params=["stored.zip", "deflated.zip", "plain.tar", "packed.tar.gz"])
def archive(request, tmp_path):
    path = tmp_path / request.param
    if request.param.endswith(".zip"):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED if request.param.startswith("s") else zipfile.ZIP_DEFLATED) as z:
            for m, t in texts().items():
                z.writestr(m, t)
    else:
        with tarfile.open(path, "w:gz" if request.param.endswith("gz") else "w") as t:
            for m, x in texts().items():
                info = tarfile.TarInfo(m)
                info.size = len(x.encode())
                t.addfile(info, io.BytesIO(x.encode()))
    return str(path)


def test_lines_of_all_members(spark, archive):
    got = archive_lines(spark, archive, split=997)
    assert sorted((x.member, x.line) for x in got.collect()) == wanted(texts())
    many = got.rdd.getNumPartitions()
    assert many > 50 if "stored" in archive or "plain" in archive else many == len(texts())


def test_only_members_that_match_are_planned(spark, archive):
    days = archive_lines(spark, archive, "posts/*")
    assert {x.member for x in days.select("member").distinct().collect()} == {f"posts/day{d}.jsonl" for d in range(4)}
    one = days.where("member = 'posts/day2.jsonl'")
    assert one.count() == 300 and one.rdd.getNumPartitions() == 1


def test_posts_of_some_accounts(spark, archive):
    people = records_of(archive_lines(spark, archive, "accounts.jsonl"), "user_id long, label int").where("label = 1")
    posts = records_of(archive_lines(spark, archive, "posts/*"), "post_id long, user_id long, text string", people)
    want = [json.loads(x) for m, t in texts().items() if m.startswith("posts/") for x in t.splitlines()]
    assert sorted(x.post_id for x in posts.collect()) == sorted(x["post_id"] for x in want if x["user_id"] % 2)


def test_a_folder_of_archives(spark, archive, tmp_path):
    assert archive_lines(spark, str(tmp_path), "accounts*").count() == 40
    assert archive_lines(spark, str(tmp_path), "nothing").count() == 0
