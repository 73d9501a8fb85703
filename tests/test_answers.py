"""What is asked of a model, how often, and what becomes of lost workers, failures and late answers."""

import os
import time
import uuid

import pytest

from tidemark.operators import verify
from tidemark.operators.verify import AnswerLog, Asking


class Counting:
    """Notes each request in a folder; the process ends at the request of a number."""

    def __init__(self, folder, ends_at=None):
        self.folder, self.ends_at = str(folder), ends_at

    def __call__(self, prompt, image):
        before = len(os.listdir(self.folder))
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write(prompt)
        if before == self.ends_at:
            os._exit(1)
        return verify.KeepAll()(prompt, image)


class Failing(Counting):
    """Answers a prompt at its third request only."""

    def __call__(self, prompt, image):
        super().__call__(prompt, image)
        if sum(open(os.path.join(self.folder, x)).read() == prompt for x in os.listdir(self.folder)) < 3:
            raise ConnectionError("busy")
        return verify.KeepAll()(prompt, image)


class Late(Counting):
    def __call__(self, prompt, image):
        if "[[2,7]]" in prompt:
            time.sleep(20)
        return super().__call__(prompt, image)


@pytest.fixture
def asked(spark):
    """Six series of 30 points, and a proposal [k, k + 5] for series k; one task asks."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    rows = spark.createDataFrame([(f"s{k}", i, 30, float(i % (k + 2))) for k in range(6) for i in range(30)], "series_id string, idx long, n long, value double")
    yield verify.prompts(spark.createDataFrame([(f"s{k}", k, k + 5) for k in range(6)], "series_id string, s long, e long")), rows
    spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.fixture
def requests(tmp_path):
    (tmp_path / "requests").mkdir()
    return tmp_path / "requests"


def pairs(raw):
    return {(r.series_id, r.s, r.e) for r in verify.answered(raw).collect()}


ALL = {(f"s{k}", k, k + 5) for k in range(6)}


def test_a_lost_worker_asks_only_what_has_no_answer(asked, requests, tmp_path):
    asking, ask = Asking(AnswerLog(str(tmp_path / "log"), "m")), Counting(requests, ends_at=3)
    with pytest.raises(Exception):
        verify.answers(*asked, ask, asking=asking).collect()
    assert len(os.listdir(requests)) == 4
    assert pairs(verify.answers(*asked, ask, asking=asking)) == ALL and len(os.listdir(requests)) == 7
    assert pairs(verify.answers(*asked, ask, asking=asking)) == ALL and len(os.listdir(requests)) == 7
    other = Asking(AnswerLog(str(tmp_path / "log"), "other"), at_once=4)
    assert pairs(verify.answers(*asked, ask, asking=other)) == ALL and len(os.listdir(requests)) == 13
    assert all(len(name) == 64 for _, _, names in os.walk(tmp_path / "log") for name in names)


def test_failures_are_asked_again_and_not_logged(asked, requests, tmp_path):
    log = AnswerLog(str(tmp_path / "log"))
    raw = verify.answers(*asked, Failing(requests), asking=Asking(log, again=1, pause=0.01)).collect()
    assert len(raw) == 6 and all(r.raw is None for r in raw) and not os.path.exists(tmp_path / "log")
    assert pairs(verify.answers(*asked, Failing(requests), asking=Asking(log, again=2, pause=0.01))) == ALL and len(os.listdir(requests)) == 18


def test_late_answers_are_none(asked, requests):
    began = time.time()
    got = {r.series_id: r.raw for r in verify.answers(*asked, Late(requests), asking=Asking(limit=1.5, at_once=3)).collect()}
    assert got["s2"] is None and sum(v is not None for v in got.values()) == 5 and time.time() - began < 19


def test_log_keeps_any_text(tmp_path):
    log = AnswerLog(f"file://{tmp_path}/a")
    assert log.get("p", b"i") is None
    log.put("p", b"i", "ä\n")
    log.put("p", b"i", "")
    assert log.get("p", b"i") == "" and log.get("pi", b"") is None and AnswerLog(f"file://{tmp_path}/a", "m").get("p", b"i") is None
