import random

from reelspark.operators.admission import Limits
from reelspark.streaming.reconcile import JOBS, reconcile_loop


def model(jobs, work, evidence, sessions, ticks, classes, batch):
    """The loop over plain rows."""
    jobs = {j[0]: dict(zip([c.split()[0] for c in JOBS.split(", ")], j, strict=True)) for j in jobs}
    out = []
    for tick, now in enumerate(ticks):
        there = {(u, s) for u, s, at in evidence if at <= now}
        for workload, lim in classes.items():
            lacking = sorted((w for w in work if w[0] not in jobs), key=lambda w: (w[3], w[1], w[2]))[:batch]
            for u, s, q, c in lacking:
                jobs[u] = {"utterance_id": u, "session_id": s, "sequence": q, "created": c, "state": "pending", "next_attempt": None, "claim_expires": None, "last_delivery": None, "updated": now}
            by_age = sorted(jobs.values(), key=lambda j: (j["updated"], j["utterance_id"]))
            done = [j for j in by_age if j["state"] != "succeeded" and (j["utterance_id"], j["session_id"]) in there][:batch]
            false = [j for j in by_age if j["state"] == "succeeded" and (j["utterance_id"], j["session_id"]) not in there][:batch]
            for rows, state in ((done, "succeeded"), (false, "pending")):
                for j in rows:
                    j.update(state=state, next_attempt=None, claim_expires=None, updated=now)
            for j in false:
                j["last_delivery"] = None

            def judged(j, now=now, lim=lim):
                due = {"retry_wait": j["next_attempt"], "claimed": j["claim_expires"]}.get(j["state"])
                waits = j["state"] == "pending" or (due is not None and due <= now)
                last = j["last_delivery"]
                recent = last is not None and last > now - lim.cooldown
                anew = last is not None and due is not None and last < due
                active = j["state"] == "claimed" and j["claim_expires"] > now
                return waits and (not recent or anew), waits and recent and not anew, active

            own = [j for j in jobs.values() if sessions[j["session_id"]] == workload]
            busy, turn, line = {}, {}, []
            for s in {j["session_id"] for j in own}:
                mine = sorted((j for j in own if j["session_id"] == s), key=lambda j: (j["sequence"], j["created"], j["utterance_id"]))
                busy[s] = sum(judged(j)[1] or judged(j)[2] for j in mine)
                times = [j["last_delivery"] for j in mine if j["last_delivery"] is not None]
                turn[s] = max(times) if times else min(j["created"] for j in mine)
                line += [(r, turn[s], s, j["utterance_id"]) for r, j in enumerate([j for j in mine if judged(j)[0]], 1) if r <= lim.per_session - busy[s]]
            given = [u for *_, u in sorted(line)[: max(0, lim.total - sum(busy.values()))]]
            for u in given:
                jobs[u].update(last_delivery=max(jobs[u]["last_delivery"] or now, now), updated=now)
            out.append((tick, workload, len(lacking), len(done), len(false), len(given), sum(judged(j)[1] for j in own)))
    return out


def test_loop_equals_the_model(spark):
    rng = random.Random(8)
    sessions = {s: "upload" if s % 3 == 0 else "live" for s in range(9)}
    states = ["pending", "claimed", "retry_wait", "succeeded", "failed", "no_speech"]
    work = [(u, rng.randrange(9), u, 100 + rng.randrange(50)) for u in range(120)]
    jobs = []
    for u, s, q, c in work[:90]:
        state = rng.choice(states)
        jobs.append((u, s, q, c, state, 195 + rng.randrange(10) if state == "retry_wait" else None, 195 + rng.randrange(12) if state == "claimed" else None, rng.choice([None, 150, 199]), 100 + rng.randrange(90)))
    evidence = [(u, s, rng.choice([100, 201, 230])) for u, s, _, _ in work if rng.random() < 0.3]
    classes = {"live": Limits(12, 3, 10), "upload": Limits(5, 2, 4)}
    ticks = [200, 201, 215]
    frames = (
        spark.createDataFrame(jobs, JOBS),
        spark.createDataFrame(work, "utterance_id bigint, session_id bigint, sequence bigint, created bigint"),
        spark.createDataFrame(evidence, "utterance_id bigint, session_id bigint, at bigint"),
        spark.createDataFrame(list(sessions.items()), "session_id bigint, workload string"),
    )
    got = reconcile_loop(spark, *frames, ticks, classes, 11)
    assert sorted(map(tuple, got.collect())) == sorted(model(jobs, work, evidence, sessions, ticks, classes, 11))


def test_rotation_over_two_ticks(spark):
    """Four sessions of two jobs, two places, one for each session: two ticks serve disjoint pairs."""
    work = [(2 * s + k, s, k, 10 + s) for s in range(4) for k in range(2)]
    frames = (
        spark.createDataFrame([], JOBS),
        spark.createDataFrame(work, "utterance_id bigint, session_id bigint, sequence bigint, created bigint"),
        spark.createDataFrame([(0, 0, 101), (2, 1, 101)], "utterance_id bigint, session_id bigint, at bigint"),
        spark.createDataFrame([(s, "live") for s in range(4)], "session_id bigint, workload string"),
    )
    got = sorted(map(tuple, reconcile_loop(spark, *frames, [100, 101], {"live": Limits(2, 1, 30)}, 8).collect()))
    assert got == [(0, "live", 8, 0, 0, 2, 2), (1, "live", 0, 2, 0, 2, 2)]
