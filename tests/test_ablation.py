"""Feature-mask ablations: masks, and scores against numpy on the real vectors."""

import numpy as np
from spanlight.operators import models as L
from spanlight.plans import ablation as A


def test_masks_and_scores(spark):
    rows, features = A.ablation_rows(spark, "/root/testdata/sf0.01")
    masks = A.masks(features)
    assert masks["without_all_process_semantics"] < masks["without_utility_indicators"] < masks["full"]
    assert masks["without_all_process_semantics"] < masks["without_path_length_parent"] < masks["full"]
    assert not any(f.startswith("utility_") for f in masks["without_utility_indicators"]) and "path_depth" not in masks["without_path_length_parent"]
    assert masks["temporal_degree_only"] | masks["process_semantics_only"] < masks["full"] and all(masks.values()) and len(features) == 55
    weighted = L.case_weights(rows, "case_id", "y").toPandas()
    whole = rows.toPandas()
    scored = A.ablated_scores(rows, features).toPandas()
    assert len(scored) == len(whole) * len(masks)
    assert len({f for f in ("name_length_log", "has_parent") if np.ptp(np.stack(whole.x)[:, features.index(f)]) > 0}) == 2
    for mask in ("full", "temporal_degree_only"):
        keep = [i for i, f in enumerate(features) if f in masks[mask]]
        for fold in sorted(set(whole.fold)):
            train = weighted[weighted.fold != fold]
            x, y, w = np.stack(train.x), train.y.to_numpy(float), train.weight.to_numpy()
            mean = (w[:, None] * x).sum(0) / w.sum()
            scale = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / w.sum())
            scale = np.where(scale > 1e-9, scale, 1)
            z = ((x - mean) / scale)[:, keep]
            base = (w * y).sum() / w.sum()
            b = np.linalg.solve((w[:, None] * z).T @ z / w.sum() + 0.01 * np.eye(len(keep)), (w[:, None] * z).T @ (y - base) / w.sum())
            test = whole[whole.fold == fold]
            want = dict(zip(zip(test.case_id, test.id), ((np.stack(test.x) - mean) / scale)[:, keep] @ b + base))
            mine = scored[(scored["mask"] == mask) & (scored.fold == fold)]
            assert len(mine) and max(abs(r.score - want[r.case_id, r.id]) for r in mine.itertuples()) < 1e-6
