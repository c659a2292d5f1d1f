"""Small logs for tests, and a sequential replay of the flow rules to compare with."""

from __future__ import annotations

import json
import random

from flowlens.sources.catalogue import build_catalogue, dag_documents
from flowlens.sources.envelopes import decode_envelopes, ledger


def start(flow, dag, **extra):
    body = {"messageName": "processFlow.initiated", "messageType": "EVENT", "source": "intake", "dagKey": dag,
            "correlationId": flow, "inputs": {"processFlow": {"id": flow}}}
    return body | extra


def event(flow, status, batch=0, task=None, action="a", retryable=None, body=None, code="COMPLETED", reason=None, **extra):
    out = {"messageName": "task.event", "messageType": "EVENT", "source": "runner", "correlationId": flow}
    if status is not None:
        out["status"] = status
    if batch is not None:
        out["batch"] = {"index": batch}
    if action is not None:
        out["action"] = {"actionName": action, "actionCode": action.upper()}
    if task is not None:
        result = {"id": task, "taskFlowResponse": {"href": "/" + task}}
        if code is not None:
            result["taskStatusCode"] = code
        if reason is not None:
            result["statusChangeReason"] = reason
        if body is not None:
            result["taskFlowResponse"]["characteristic"] = [{"name": "taskstatus", "value": body}]
        out["result"] = result
    if retryable is not None:
        out["error"] = {"retryable": retryable}
    return out | extra


def log_frame(spark, messages):
    rows = [(i, m if isinstance(m, str) or m is None else json.dumps(m)) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, "arrival_seq long, value string")


def envelopes(spark, messages):
    stamped = [m if not isinstance(m, dict) else {"eventId": f"e{i}", **m} for i, m in enumerate(messages)]
    return decode_envelopes(log_frame(spark, stamped)).good


def ledger_of(spark, messages, chunk_rows=4):
    return ledger(envelopes(spark, messages), chunk_rows)


def catalogue_of(spark, dags):
    """``dags``: key -> list of (index, [action…] or None)."""
    docs = [
        {"dagKey": k, "batches": [
            {"index": i, "actions": None if a is None else [x if isinstance(x, dict) else {"actionName": x} for x in a]}
            for i, a in b]}
        for k, b in dags.items()
    ]
    return build_catalogue(dag_documents(spark, docs))


class Replay:
    """One message after the other, exactly as the rules are written down."""

    def __init__(self, dags):
        self.dags = {k: {} for k in dags}
        for k, batches in dags.items():
            for i, actions in batches:
                self.dags[k].setdefault(i, len(actions or []))
        self.barriers, self.tasks, self.ends, self.initials = {}, {}, [], []

    def run(self, messages):
        for seq, m in enumerate(messages):
            if m["messageName"] == "processFlow.initiated":
                self.initiate(seq, m)
            elif m["messageName"] == "task.event":
                self.upsert(seq, m)
                self.apply(seq, m)
        return self

    def initiate(self, seq, m):
        flow, dag = m["inputs"]["processFlow"]["id"], m.get("dagKey")
        if dag not in self.dags or 0 not in self.dags[dag] or (flow, 0) in self.barriers:
            return
        self.initials.append((flow, seq, dag))
        self.seed(seq, flow, dag, 0)

    def seed(self, seq, flow, dag, index):
        if self.dags[dag][index] == 0:
            text = f"DAG {dag} batch {index} has no actions"
            self.ends.append((flow, seq, "failed", text, "FAILED", "No Task/Action Performed"))
            return
        self.barriers[flow, index] = {
            "dag": dag, "total": self.dags[dag][index], "done": 0, "bad": 0, "status": "OPEN", "opened": seq, "closed": None,
        }

    def upsert(self, seq, m):
        result, action, batch = m.get("result"), m.get("action"), m.get("batch")
        if not (result and action and batch and m.get("status")):
            return
        key = m["correlationId"], result["id"]
        first = self.tasks[key]["first"] if key in self.tasks else seq
        self.tasks[key] = {"first": first, "action": action["actionName"], "batch": batch["index"], "status": m["status"],
                           "result": result}

    def apply(self, seq, m):
        if not m.get("status") or not m.get("batch"):
            return
        flow, index, status = m["correlationId"], m["batch"]["index"], m["status"]
        if status not in ("COMPLETED", "FAILED", "CANCELLED"):
            return
        b = self.barriers.get((flow, index))
        if b is None or b["status"] != "OPEN":
            return
        if status == "COMPLETED":
            b["done"] += 1
        elif (m.get("error") or {}).get("retryable"):
            return
        else:
            b["bad"] += 1
        if b["done"] + b["bad"] == b["total"]:
            self.close(seq, flow, index, b)

    def close(self, seq, flow, index, b):
        rows = sorted((t for (f, _), t in self.tasks.items() if f == flow and t["batch"] == index), key=lambda t: t["first"])
        kickout = next((r for r in map(self.row_reason, rows) if r), None)
        b["closed"] = seq
        values = self.final([t["result"] for t in rows])
        if kickout:
            b["status"] = "FAILED"
            self.ends.append((flow, seq, "failed", f"batch {index} kickout: {kickout}", *values))
            return
        b["status"] = "CLOSED"
        if index + 1 in self.dags[b["dag"]]:
            self.seed(seq, flow, b["dag"], index + 1)
        else:
            self.ends.append((flow, seq, "completed", None, *values))

    @staticmethod
    def row_reason(t):
        if t["status"] != "COMPLETED":
            return f"action={t['action']} row.status={t['status']}"
        for a in t["result"].get("taskFlowResponse", {}).get("characteristic") or []:
            if a["name"].lower() == "taskstatus":
                if a["value"] is not None and a["value"].lower() != "passed":
                    return f"action={t['action']} actionResponse.taskFlowResponse.taskStatus={a['value']}"
                return None
        return None

    @staticmethod
    def final(results):
        if not results:
            return "FAILED", "No Task/Action Performed"
        codes = [r.get("taskStatusCode") for r in results]
        upper = [c.upper() for c in codes if c is not None]
        if None in codes or "ERROR" in upper:
            status = "ERROR"
        else:
            status = next((s for s in ("FAILED", "ERROR_701") if s in upper), "Passed")
        reason = next((r["statusChangeReason"] for r in results if (r.get("statusChangeReason") or "").strip()), None)
        return status, reason or ("Process Flow Success" if status == "Passed" else "Process Flow Failure")

    def barrier_rows(self):
        return {
            (f, i, b["dag"], b["total"], b["done"], b["bad"], b["status"], b["opened"], b["closed"])
            for (f, i), b in self.barriers.items()
        }


RANDOM_DAGS = {
    "one": [(0, ["a"])],
    "wide": [(0, ["a", "b", "c"]), (1, ["d", "e"]), (2, ["f"])],
    "hollow": [(0, ["a"]), (1, [])],
    "empty": [(0, None)],
    "gap": [(0, ["a", "b"]), (2, ["c"])],
    "late": [(1, ["a"])],
}


def random_log(seed, flows=120, rows=6000, hot_share=0.0):
    """Messages of many flows, shuffled together; ``hot_share`` of them belong to flow f0."""
    rnd = random.Random(seed)
    dag_of = {f: rnd.choice([*RANDOM_DAGS, "nowhere", "wide", "wide"]) for f in range(flows)}
    dag_of[0] = "wide"
    out = []
    for _ in range(rows):
        f = 0 if rnd.random() < hot_share else rnd.randrange(flows)
        flow = f"f{f}"
        if rnd.random() < 0.08:
            dag = dag_of[f] if rnd.random() < 0.8 else rnd.choice(list(RANDOM_DAGS))
            out.append(start(flow, dag))
            continue
        status = rnd.choices(
            ["COMPLETED", "FAILED", "CANCELLED", "WAITING", "IN_PROGRESS", None], [80, 4, 2, 6, 4, 4]
        )[0]
        out.append(event(
            flow, status,
            batch=rnd.choice([0, 0, 1, 1, 2, None]),
            task=rnd.choice([None, *(f"t{n}" for n in range(6))]),
            action=rnd.choice(["a", "b", "c", None]),
            retryable=rnd.choice([None, True, False]),
            body=rnd.choices([None, "Passed", "PASSED", "Failed"], [50, 30, 15, 5])[0],
            code=rnd.choices(["COMPLETED", "error", "FAILED", "ERROR_701", None], [90, 3, 3, 2, 2])[0],
            reason=rnd.choices([None, "  ", "why"], [80, 10, 10])[0],
        ))
    return out
