"""The URL models, their threshold and every verdict against a plain form."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessella.llm import queries, urlfilter
from tessella.llm.common import read


def coded(text):
    plain = text.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    plain = re.sub("[^a-z0/.-]", "~", re.sub("[0-9]", "0", plain))
    return [urlfilter.LETTERS.index(c) + 1 for c in plain]


class PlainModel:
    """Interpolated Witten-Bell smoothing by its recursion."""

    def __init__(self, texts):
        self.counts = defaultdict(Counter)
        for text in texts:
            codes = [0, 0, 0, *coded(text)]
            for i in range(3, len(codes)):
                for k in range(4):
                    self.counts[tuple(codes[i - k : i])][codes[i]] += 1

    def chance(self, context, letter):
        if context is None:
            return 1 / urlfilter.SYMBOLS
        low = self.chance(context[1:] if context else None, letter)
        seen = self.counts.get(tuple(context))
        return (seen[letter] + len(seen) * low) / (sum(seen.values()) + len(seen)) if seen else low


def plain_scores(accepted, rejected, texts):
    a, r = PlainModel(accepted), PlainModel(rejected)
    out = []
    for text in texts:
        codes = [0, 0, 0, *coded(text)]
        parts = [math.log(a.chance(codes[i - 3 : i], codes[i]) / r.chance(codes[i - 3 : i], codes[i])) for i in range(3, len(codes))]
        out.append(sum(parts) / len(parts) if parts else 0.0)
    return out


def plain_threshold(scored):
    steps = sorted({math.floor(s * urlfilter.STEPS) for s, _ in scored})
    sides = [[math.floor(s * urlfilter.STEPS) for s, good in scored if good is side] for side in (True, False)]
    if not all(sides):
        return 0.0
    found = []
    for i, step in enumerate(steps):
        cut = (step + (steps[i - 1] + 1 if i else step)) / 2
        missed = sum(s < step for s in sides[0]) / len(sides[0])
        passed = sum(s >= step for s in sides[1]) / len(sides[1])
        found.append((round(missed + passed, 12), abs(cut), cut))
    return min(found)[2] / urlfilter.STEPS


def test_every_score_and_verdict_equals_the_plain_models(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    more = [(-1, None), (-2, ""), (-3, "no scheme/at all?q=1"), (-4, "https://x.net/a?token=" + "é" * 50), (-5, "http://y.net/" + "long/" * 9_000)]
    pages = pages.unionByName(spark.createDataFrame(more, pages.schema))
    held = F.pmod(F.xxhash64(urlfilter.scored_text("url")), F.lit(urlfilter.CALIBRATE)) == 0
    told = {r.page_id: (re.sub("^[^:/?#]*://", "", r.url or ""), r.held) for r in pages.withColumn("held", held).collect()}
    got = {r.page_id: r for r in urlfilter.judge(pages, queries.URL_RULES).collect()}
    assert set(got) == set(told)
    label = {k: r.verdict == "allow" for k, r in got.items() if r.rule is not None}
    learn = lambda side: [told[k][0] for k, good in label.items() if good is side and not told[k][1]]
    free = [k for k in got if k not in label]
    kept = [k for k in label if told[k][1]]
    scores = plain_scores(learn(True), learn(False), [told[k][0] for k in [*free, *kept]])
    cut = plain_threshold(list(zip(scores[len(free) :], (label[k] for k in kept), strict=True)))
    assert free and kept
    for k, score in zip(free, scores, strict=False):
        assert abs(got[k].score - score) < 1e-9, told[k]
        assert got[k].verdict == ("allow" if score >= cut else "block") or abs(score - cut) < 1e-9
