"""Short sequential answers to check the Spark jobs against."""

from collections import deque

import numpy as np


def sliding_window(vectors, window, threshold):
    """(duplicate, cluster number, similarity, matched position) in order."""
    recent, out, opened = deque(maxlen=window), [], 0
    for position, vector in enumerate(vectors):
        sims = [round(float(np.dot(v, vector)), 10) for v, _, _ in recent]
        top = int(np.argmax(sims)) if sims else -1
        best = sims[top] if sims else 0.0
        if sims and best >= threshold:
            cluster, matched = recent[top][1], recent[top][2]
            out.append((True, cluster, best, matched))
        else:
            cluster = opened
            opened += 1
            out.append((False, cluster, best, None))
        recent.append((vector, cluster, position))
    return out
