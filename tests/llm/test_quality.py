"""Line-first cleaning: base figures against brute force, rules by example."""

import random
import re

from mediacat.llm import quality as Q
from tests.llm.fixtures import frame, logs, text


def by_hand(log):
    log = log or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", log)
    lines = [x for x in log.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            twice.update(range(i, i + 5))
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(w) < 10 or 100 * len(twice) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in log), dup, len(twice), failed


def test_base_figures(spark):
    rng = random.Random(3)
    rows = logs(5) + [(500 + i, (text(rng, 30) + "\n") * rng.randrange(1, 4) + "#a| <b>\x0bé") for i in range(20)]
    got = {r.job_id: r for r in Q.clean_logs(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for j, log in rows:
        r = got[j]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == by_hand(log), j
        assert not (r.base_failed and r.kept)


def test_line_rules():
    for line, why in [
        ("frame one of the encoder was late but arrived.", None),
        ("a### b%%% c$$$ d*** e&&&", "punctuation"),
        ("THIS IS SHOUTED AT EVERYONE NOW", "punctuation"),
        ("stop! now! please! here", "punctuation"),
        ("Home About Contact", "navigation"),
        ("encoderstarted | queuedfilms | nodesbusyagain | leasesended", "navigation"),
        ("Copyright by us. All rights reserved.", "boilerplate"),
        ("the the the of of of", "boilerplate"),
    ]:
        assert Q.bad_line(line, line.split()) == why, line


def test_verdict_and_odd_rows(spark):
    good = "the encoder started at noon and wrote all frames of the film to disk."
    rows = [
        (1, good), (1, good), (2, good + "\nHome About Contact"), (3, "AAA BBB CCC DDD EEE FFF\n" * 1 + "one two three four five six"),
        (4, None), (None, good), (5, "word " * 9), (6, "w%d " * 0 + " ".join(f"w{i}" for i in range(50_000))),
    ]
    got = sorted((r.job_id or 99, r.kept, r.n_bad_lines) for r in Q.clean_logs(frame(spark, rows)).collect())
    assert got == [(1, True, 0), (1, True, 0), (2, True, 1), (3, True, 1), (4, False, 0), (5, False, 1), (6, True, 0), (99, True, 0)]
    cleaned = {r.job_id: r.cleaned for r in Q.clean_logs(frame(spark, rows)).collect()}
    assert cleaned[2] == good and cleaned[4] == ""
    assert Q.clean_logs(frame(spark, rows).limit(0)).count() == 0
