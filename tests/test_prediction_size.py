"""Prediction at size: memory doesn't grow with a batch."""

import numpy as np
import pandas as pd
from test_training import some

from echolith.plans import model


def test_a_large_batch_is_predicted_a_few_records_at_a_time(monkeypatch):
    x, _ = some(700)
    w = {1: model.initial_weights(1), 2: model.initial_weights(2)}
    df = pd.DataFrame({"name": range(700), "band": [1 + (i % 7 == 0) for i in range(700)], "tae": list(x)})
    sizes, whole = [], model.forward
    monkeypatch.setattr(model, "forward", lambda p, x: sizes.append(len(x)) or whole(p, x))
    got = pd.concat(model._predicted(w, ["name", "band"])(iter([df]))).sort_values("name")
    assert max(sizes) <= model.TOGETHER and sum(sizes) == 700 and got["name"].tolist() == list(range(700))
    want = np.stack([whole(w[b], x[i : i + 1])[0] for i, b in zip(df["name"], df["band"])])
    assert np.allclose(got[list(model.DESCRIPTORS)].to_numpy(), want)
