import numpy as np
from pyspark import cloudpickle

from trialkit.llm import words


def split(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return words.split(data, np.array([0, len(data)]), words.BLANKS_LOWER)


def test_functions_sent_to_tasks_leave_the_tables_of_powers_behind():
    here = split("some words of the driver").hash
    sent = cloudpickle.dumps(words.split)
    assert len(words._powers) == 2 and len(sent) < 200_000
    data = np.frombuffer(b"some words of the driver", np.uint8)
    assert (cloudpickle.loads(sent)(data, np.array([0, len(data)]), words.BLANKS_LOWER).hash == here).all()
