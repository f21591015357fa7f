"""The licence classifier restated in plain Python: terms by a loop, probabilities by a softmax."""

import re

import numpy as np


def probabilities(model, paragraphs: list[str]) -> list[float]:
    """The largest probability of each paragraph over all families."""
    at = {t: i for i, t in enumerate(model.vocabulary)}
    weights, start = model.regression.coefficientMatrix.toArray(), model.regression.interceptVector.toArray()
    out = []
    for text in paragraphs:
        words = re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower())
        terms = {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}
        scores = start + weights[:, sorted(at[t] for t in terms if t in at)].sum(axis=1)
        odds = np.exp(scores - scores.max())
        out.append(float(odds.max() / odds.sum()))
    return out
