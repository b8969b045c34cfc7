"""Cases of the round's findings on the operators, each of which failed before."""

import numpy as np
import pandas as pd

from spanmill.llm import ann, toxicity


def test_rows_unlike_most_find_their_nearest(spark):
    own = np.random.default_rng(3)
    many = own.normal(size=(3000, 16)).astype(np.float32)
    many[:1500] = many[0] + own.normal(size=(1500, 16)) * 1e-3  # of one code in one cell
    many[1500:2700] = many[1500:1520].repeat(60, axis=0) + own.normal(size=(1200, 16)) * 0.05
    many[::100] = own.normal(size=(30, 16)) * 4  # what is asked lies where little of the sample does
    many[50::100] = many[0] + own.normal(size=(30, 16)) * 1e-3
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(3000), "embedding": [list(map(float, v)) for v in many]}), "vec_id long, embedding array<float>")
    got: dict[int, list] = {}
    for r in ann.nearest(df, every=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    wide = many.astype(np.float64)
    hits = 0
    for q in range(0, 3000, 50):
        gap = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(3000), gap)) if i != q][:10]
        hits += len(set(want) & {i for _, i in got[q]})
    assert hits == 600


def test_masks_are_read_alike_in_tokens_of_any_length():
    model = toxicity.log_model(np.bincount(toxicity.grams("idiot scum the moron loser stupid trash and this is " * 50), minlength=toxicity.ALPHABET**4).astype(float))
    long = "-".join(["st*pid", "tr*sh", "m*r*n", "s***id"] * 20)
    assert toxicity.decode(long, model) == "".join(toxicity.decode(x, model) for x in long.split("-")) == "stupidtrashmoronstupid" * 20
    # No reading that the search could have kept is likelier: it equals the one over plain states without a bound.
    own, r = toxicity.BEAM, np.random.default_rng(5)
    token = "".join(r.choice(list("abst*#1!.-"), 90))
    try:
        toxicity.BEAM = 10**9
        plain = toxicity.decode(token, model)
    finally:
        toxicity.BEAM = own
    assert toxicity.decode(token, model) == plain
