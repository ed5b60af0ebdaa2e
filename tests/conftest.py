import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from riskflow.session import local_session

    s = local_session(4, shuffle_partitions=4, app="riskflow-tests")
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"


#: A valid event of the tests' own; vary it with ``event(...)``.
EVENT = {
    "event_id": "p-204",
    "timestamp": "2025-07-03T11:20:05Z",
    "user_id": "U77",
    "type": "TRANSFER",
    "amount": 61.5,
    "old_balance_orig": 80.0,
    "new_balance_orig": 18.5,
}


def event(**changes):
    """The valid event as JSON text with some members changed."""
    import json

    return json.dumps(EVENT | changes)
