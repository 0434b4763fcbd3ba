"""State machines of live streams as pure functions (state, row) -> (state, outputs), and their batch and streaming drivers.

A batch driver folds each key's rows in order; the streaming driver keeps the state in Spark's state store. Both call
the same function, so their outputs agree. State is small and bounded: counters, and the last probabilities.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[dict, dict], tuple[dict, list[dict]]]

#: Parameters of the hybrid machine, in frames unless named otherwise.
VAD = {
    "threshold": 0.5, "start_frames": 30, "start_share": 0.6, "pad": 5, "end_silence": 20, "soft_limit": 450, "hard_limit": 800,
    "valley": 0.65, "valley_run": 5, "valley_window": 200, "keep": 1024, "smooth": 5,
}


def _valley(probs: list[float], p: dict) -> bool:
    run = 0
    for x in probs[-p["valley_window"] :]:
        run = run + 1 if x < p["valley"] else 0
        if run >= p["valley_run"]:
            return True
    return False


def hybrid_vad(p: dict | None = None) -> Step:
    """SILENCE, POSSIBLE_SPEECH, SPEECH, POSSIBLE_SILENCE. Rows have idx and prob; outputs have start, end (inclusive) and reason.

    Speech begins once ``start_frames`` frames were seen since the first speech frame with at least ``start_share`` of them
    above the threshold; it ends after ``end_silence`` silent frames, at a valley beyond the soft limit, or at the hard limit, after which
    the machine goes on in speech. A probability outside [0, 1] is an error."""
    p = VAD | (p or {})

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        prob, idx = row["prob"], row["idx"]
        if prob is None or not 0.0 <= prob <= 1.0:
            raise ValueError(f"probability {prob} at frame {idx} is outside [0, 1]")
        s = dict(s) or {"state": "SILENCE", "start": None, "seen": 0, "hits": 0, "silent": 0, "recent": [], "probs": []}
        recent = (s["recent"] + [prob])[-p["smooth"] :]
        s["recent"] = recent
        smooth = sum(recent) / len(recent)
        speech = smooth >= p["threshold"]
        s["probs"] = (s["probs"] + [smooth])[-p["keep"] :] if s["state"] != "SILENCE" else []
        out: list[dict] = []
        if s["state"] == "SILENCE":
            if speech:
                s |= {"state": "POSSIBLE_SPEECH", "start": max(0, idx - p["pad"]), "seen": 1, "hits": 1, "probs": [smooth]}
        elif s["state"] == "POSSIBLE_SPEECH":
            s["seen"] += 1
            s["hits"] += speech
            if s["hits"] >= p["start_frames"] and s["hits"] / s["seen"] >= p["start_share"]:
                s |= {"state": "SPEECH", "silent": 0}
            elif s["hits"] / s["seen"] < p["start_share"] and s["seen"] >= p["start_frames"]:
                s |= {"state": "SILENCE", "start": None, "seen": 0, "hits": 0}
        else:
            s["silent"] = 0 if speech else s["silent"] + 1
            s["state"] = "SPEECH" if speech else "POSSIBLE_SILENCE"
            length = idx - s["start"] + 1
            if s["silent"] >= p["end_silence"]:
                out.append({"start": s["start"], "end": idx - s["silent"] + min(p["pad"], s["silent"]), "reason": "silence"})
                s |= {"state": "SILENCE", "start": None, "seen": 0, "hits": 0, "silent": 0, "probs": []}
            elif length >= p["hard_limit"] or length > p["soft_limit"] and _valley(s["probs"], p):
                out.append({"start": s["start"], "end": idx, "reason": "hard" if length >= p["hard_limit"] else "valley"})
                s |= {"start": idx + 1, "silent": 0, "state": "SPEECH", "probs": []}
        return s, out

    return step


def chunk_accumulator(flush: int = 1200, least: int = 60) -> Step:
    """Collects speech rows (idx, speech) to segments; flushes long ones, drops short ones."""

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        s, out = dict(s), []
        if row["speech"]:
            s.setdefault("start", row["idx"])
            s["end"] = row["idx"]
            if s["end"] - s["start"] + 1 >= flush:
                out.append({"start": s.pop("start"), "end": s.pop("end"), "reason": "flush"})
        elif "start" in s:
            if s["end"] - s["start"] + 1 >= least:
                out.append({"start": s["start"], "end": s["end"], "reason": "end"})
            s = {}
        return s, out

    return step


def chunk_classifier(speech: float = 0.5, audible: float = 0.001, loud: float = 0.12, full: int = 30, burst: int = 10) -> Step:
    """Groups audible chunks of one kind (idx, prob, rms): saved after ``full`` chunks, or after ``burst`` on a loud one."""

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        s, out = dict(s), []
        kind = "speech" if row["prob"] >= speech else "sound" if row["rms"] >= audible else ""
        if s and s["kind"] != kind:
            out.append({"start": s["start"], "end": s["end"], "reason": s["kind"]})
            s = {}
        if kind:
            s = {"kind": kind, "start": s.get("start", row["idx"]), "end": row["idx"]}
            n = s["end"] - s["start"] + 1
            if n >= full or n >= burst and row["rms"] >= loud:
                out.append({"start": s["start"], "end": s["end"], "reason": kind})
                s = {}
        return s, out

    return step


def decayed_words(rate: float = 0.85, least: float = 0.5, top: int = 20) -> Step:
    """Word weights: each row's tokens (trimmed, longer than one letter, no digits) count 1, then all decay and the light ones go.
    Outputs the heaviest words of each row, earlier ones first on ties."""

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        weights = dict(s.get("w", {}))
        for token in row["tokens"] if row["tokens"] is not None else []:
            token = (token or "").strip()
            if len(token) > 1 and not token.isdigit():
                weights[token] = weights.get(token, 0.0) + 1.0
        ranked = sorted(weights.items(), key=lambda x: -x[1])[:top]
        out = [{"idx": row["idx"], "rank": k + 1, "word": w, "weight": x} for k, (w, x) in enumerate(ranked)]
        return {"w": {k: x * rate for k, x in weights.items() if x * rate >= least}}, out

    return step


def speaker_ids(threshold: float = 0.75, most: int | None = 10) -> Step:
    """The most similar prototype's id, or a new one; beyond ``most`` the nearest. Prototypes are never changed."""

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        held = [list(x) for x in s.get("p", [])]
        v = [float(x) for x in row["vector"]]
        n = sum(x * x for x in v) ** 0.5 or 1e-12
        v = [x / n for x in v]
        scores = [sum(a * b for a, b in zip(v, h)) for h in held]
        best = max(range(len(scores)), key=lambda k: (scores[k], -k)) if scores else -1
        if best >= 0 and (scores[best] >= threshold or most is not None and len(held) >= most):
            return {"p": held}, [{"idx": row["idx"], "speaker": best, "similarity": scores[best]}]
        return {"p": [*held, v]}, [{"idx": row["idx"], "speaker": len(held), "similarity": 1.0}]

    return step


def memory_tiers(sizes: tuple[int, int, int] = (8, 8, 8), ratio: int = 4) -> Step:
    """First in, first out over short, medium and long memory; ``ratio`` overflowing vectors are averaged to one of the next tier."""

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        tiers = [list(t) for t in s.get("t", [[], [], []])]
        tiers[0].append([float(x) for x in row["vector"]])
        for k in range(3):
            while len(tiers[k]) > sizes[k]:
                n = ratio if k < 2 and len(tiers[k]) - sizes[k] >= ratio else 0
                if k == 2:
                    tiers[k].pop(0)
                elif n:
                    some, tiers[k] = tiers[k][:n], tiers[k][n:]
                    tiers[k + 1].append([sum(c) / n for c in zip(*some)])
                else:
                    break
        return {"t": tiers}, [{"idx": row["idx"], "short": len(tiers[0]), "medium": len(tiers[1]), "long": len(tiers[2])}]

    return step


def pending_pairs(most: int = 50) -> Step:
    """Early and late halves of a record by id: a late half (kind final) meets its early one; above ``most`` pending ids the least goes."""

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        held = dict(s.get("h", {}))
        key = str(row["id"])
        if row["kind"] == "final":
            early = held.pop(key, None)
            return {"h": held}, [{"id": row["id"], "early": early, "late": row["text"]}]
        held[key] = row["text"]
        while len(held) > most:
            del held[min(held, key=int)]
        return {"h": held}, []

    return step


def partial_final(every: float = 4.5, longest: float = 20.0, least: float = 0.25) -> Step:
    """Partial results of an utterance at intervals, a final one at its end (flag) or when it is too long. Rows: t, seconds, end."""

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        s = dict(s) or {"held": 0.0, "sent": 0.0}
        s["held"] += row["seconds"]
        if row["end"] or s["held"] > longest:
            out = [{"idx": row["idx"], "kind": "final", "seconds": s["held"]}] if s["held"] >= least else []
            return {}, out
        if s["held"] - s["sent"] >= every:
            s["sent"] = s["held"]
            return s, [{"idx": row["idx"], "kind": "partial", "seconds": s["held"]}]
        return s, []

    return step


def fold_batch(rows: DataFrame, key: list[str], order: list[str], step: Step, outputs: str, finish: Callable[[dict], list[dict]] | None = None) -> DataFrame:
    """Fold each key's rows in order. outputs: DDL of the output fields; key columns come first. finish: outputs of a state left open."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = ", ".join(f"{k} {kinds[k]}" for k in key) + ", " + outputs
    names = [x.split()[0] for x in outputs.split(", ")]

    def work(part: pd.DataFrame) -> pd.DataFrame:
        state: dict = {}
        out: list[dict] = []
        for row in part.sort_values(order, kind="stable").to_dict("records"):
            state, made = step(state, row)
            out += made
        if finish:
            out += finish(state)
        done = pd.DataFrame({n: pd.Series([o.get(n) for o in out], dtype=object) for n in names})
        for k, c in enumerate(key):
            done.insert(k, c, part[c].iloc[0])
        return done

    return rows.groupBy(*key).applyInPandas(work, ddl)


def fold_stream(rows: DataFrame, key: list[str], order: list[str], step: Step, outputs: str) -> DataFrame:
    """The same fold over a stream: the state is kept as JSON in the state store; each micro-batch's rows of a key are sorted."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = ", ".join(f"{k} {kinds[k]}" for k in key) + ", " + outputs
    names = [x.split()[0] for x in outputs.split(", ")]

    def work(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        out: list[dict] = []
        for row in pd.concat(list(parts)).sort_values(order, kind="stable").to_dict("records"):
            held, made = step(held, row)
            out += made
        state.update((json.dumps(held),))
        done = pd.DataFrame({n: pd.Series([o.get(n) for o in out], dtype=object) for n in names})
        for k, value in enumerate(group):
            done.insert(k, key[k], value)
        yield done

    return rows.groupBy(*key).applyInPandasWithState(work, ddl, "state string", "append", GroupStateTimeout.NoTimeout)


def ring(buffer, new, size: int):
    """The last ``size`` samples of two array columns."""
    both = F.concat(buffer, new)
    return F.when(F.size(both) > size, F.slice(both, -size, size)).otherwise(both)


def not_tiny_or_silent(content, least: int = 800):
    """Binary with at least so many bytes that are not all zero."""
    return (F.length(content) >= least) & ~F.hex(content).rlike("^0*$")


def recent_rows(rows: DataFrame, time: str, now: str, seconds: float = 300.0) -> DataFrame:
    """Rows later than ``now`` - seconds (a literal time, never the clock); rows without a time stay."""
    return rows.where(F.col(time).isNull() | (F.col(time) > F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds))))


def event_tokens(rows: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """The text of the last ``done`` event of each key, from JSON payloads with type and text."""
    parsed = rows.withColumn("_p", F.from_json(payload, "type string, text string")).where("_p.type = 'done'")
    return parsed.groupBy(key).agg(F.max_by("_p.text", order).alias("text"))


def windowed_counts(rows: DataFrame, time: str, key: str, value: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling event-time counts with a watermark; works on tables and streams."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def segment_events(pre_roll: int = 200) -> Step:
    """Start and end events of segments (start, end, reason): a start reaches back ``pre_roll`` frames, but not behind a forced split."""

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        forced = s.get("reason") in ("hard", "valley")
        begin = row["start"] if forced else max(s.get("end", -1) + 1, row["start"] - pre_roll, 0)
        out = [{"event": "start", "frame": int(begin), "reason": None}, {"event": "end", "frame": int(row["end"]), "reason": row["reason"]}]
        return {"end": int(row["end"]), "reason": row["reason"]}, out

    return step


def incremental_transcript(cutoff: float = 75.0) -> Step:
    """Texts that grow: each row's text is compared with the one before; what is new is kept in sentences, unless the old text is
    not found again, when all of it is new."""
    from ..functions.textual import appended_text, partial_ratio

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        before, text = s.get("text", ""), row["text"] or ""
        tail = before[-40:]
        again = bool(before) and partial_ratio(tail, text) >= cutoff
        new = appended_text(before, text) if again else text
        return {"text": text}, [{"idx": row["idx"], "is_continued": again, "new_text": new}]

    return step
