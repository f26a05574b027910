"""Small job logs with copies, near copies, shared passages and odd rows."""

import random

WORDS = "frame error hevc queue lease node stall mux demux probe codec track audio video size bitrate".split()
SCHEMA = "job_id bigint, log string, n bigint, keys string, block string, score int"


def text(rng, n, words=WORDS):
    out = [rng.choice(words) + rng.choice(["", "", ",", "."]) + str(rng.randrange(40)) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for w in out).strip()


def logs(seed=1, n=120):
    """(job_id, log) in random order: plain, copied, mutated and passage-sharing logs, and odd ones."""
    rng = random.Random(seed)
    passage, base = text(rng, 70), text(rng, 120)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            rows.append((i, base))
        elif kind == 1:
            w = base.split(" ")
            for _ in range(rng.randrange(1, 14)):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(10**6))
            rows.append((i, " ".join(w)))
        elif kind == 2:
            rows.append((i, text(rng, rng.randrange(1, 60)) + " " + passage + "\n" + text(rng, 20)))
        else:
            rows.append((i, text(rng, rng.randrange(0, 150))))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one two"), (n + 4, "ONE two"), (n + 5, "ab" * 3000), (n + 6, passage + " " + passage)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    """With other columns whose names the operators use themselves."""
    return spark.createDataFrame([(j, t, 7, "k", "b", None) for j, t in rows], SCHEMA)
