"""What the exchanges of the account history carry."""

import datetime as dt

from tidewatch import schema as S
from tidewatch.operators.history import add_history


def _exchanges(df):
    found, waiting = [], [df._jdf.queryExecution().optimizedPlan()]
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "RepartitionByExpression":
            output = node.output()
            found.append([output.apply(i).name() for i in range(output.size())])
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return found


def test_exchanges_carry_no_derived_times_and_units_and_the_fewer_results(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [(i, at + dt.timedelta(hours=i), f"s{i % 3}", f"r{i % 4}", 10.0 + i, "A", "B") for i in range(20)]
    df = spark.createDataFrame(rows, ["id", S.TIMESTAMP, S.SENDER, S.RECEIVER, S.AMOUNT, S.PAID_IN, S.RECEIVED_IN])
    built = add_history(df, ["id"])
    assert built.columns[: len(df.columns)] == df.columns and built.columns[-1] == "receiver_in_degree"
    later, first = _exchanges(built)
    for carried in (first, later):
        assert not {"__us", "__x"} & set(carried)
    results = set(later) - set(df.columns)
    assert results and all(c.startswith(("receiver_", "h_")) for c in results) and len(results) == 4
    assert built.count() == 20
