import pytest

from flowlens.operators import barriers as B

SCHEMA = (
    "case string, first_seq long, status string, action_name string,"
    "verdict struct<parsed:boolean,body_status:string,status_code:string,change_reason:string>"
)
OK = (True, None, "COMPLETED", None)


def outcome(spark, cases):
    rows = [(name, i, status, "act", verdict) for name, tasks in cases.items() for i, (status, verdict) in enumerate(tasks)]
    found = B.final_values(B.decide(spark.createDataFrame(rows, SCHEMA), ("case",)))
    return {r.case: (r.kickout, r.process_status, r.status_change_reason) for r in found.collect()}


CASES = {
    "clean": ([("COMPLETED", OK)], (None, "Passed", "Process Flow Success")),
    "null code": ([("COMPLETED", OK), ("COMPLETED", (True, None, None, None))], (None, "ERROR", "Process Flow Failure")),
    "null code beats failed": (
        [("COMPLETED", (True, None, "FAILED", None)), ("COMPLETED", (True, None, None, None))],
        (None, "ERROR", "Process Flow Failure"),
    ),
    "error any case": ([("COMPLETED", (True, None, "error", None))], (None, "ERROR", "Process Flow Failure")),
    "error beats failed": (
        [("COMPLETED", (True, None, "FAILED", None)), ("COMPLETED", (True, None, "ERROR", None))],
        (None, "ERROR", "Process Flow Failure"),
    ),
    "failed beats 701": (
        [("COMPLETED", (True, None, "ERROR_701", None)), ("COMPLETED", (True, None, "Failed", None))],
        (None, "FAILED", "Process Flow Failure"),
    ),
    "701": ([("COMPLETED", (True, None, "error_701", None)), ("COMPLETED", OK)], (None, "ERROR_701", "Process Flow Failure")),
    "cancelled code passes": ([("COMPLETED", (True, None, "CANCELLED", None))], (None, "Passed", "Process Flow Success")),
    "only unreadable bodies": (
        [("COMPLETED", (False, None, None, None)), ("COMPLETED", (False, None, None, None))],
        (None, "Passed", "Process Flow Success"),
    ),
    "first usable reason": (
        [("COMPLETED", (True, None, "FAILED", "  ")), ("COMPLETED", (True, None, "X", "second")), ("COMPLETED", (True, None, "X", "third"))],
        (None, "FAILED", "second"),
    ),
    "row status": ([("WAITING", OK)], ("action=act row.status=WAITING", "Passed", "Process Flow Success")),
    "null row status is no kickout": ([(None, OK)], (None, "Passed", "Process Flow Success")),
    "body status": (
        [("COMPLETED", (True, "Aborted", "COMPLETED", None))],
        ("action=act actionResponse.taskFlowResponse.taskStatus=Aborted", "Passed", "Process Flow Success"),
    ),
    "body passed any case": ([("COMPLETED", (True, "pASSED", "COMPLETED", None))], (None, "Passed", "Process Flow Success")),
    "row beats body": (
        [("FAILED", (True, "Aborted", "COMPLETED", None))],
        ("action=act row.status=FAILED", "Passed", "Process Flow Success"),
    ),
    "first failing row wins": (
        [("COMPLETED", OK), ("COMPLETED", (True, "No", "COMPLETED", None)), ("FAILED", OK)],
        ("action=act actionResponse.taskFlowResponse.taskStatus=No", "Passed", "Process Flow Success"),
    ),
}


@pytest.fixture(scope="module")
def found(spark):
    return outcome(spark, {k: v[0] for k, v in CASES.items()})


@pytest.mark.parametrize("case", CASES)
def test_case(found, case):
    assert found[case] == CASES[case][1]
