"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose
data and cores. Every query is built and fully evaluated (no-op sink), once to warm up
and then ``BENCH_RUNS`` times (default 3); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "overlay_assets", "overlay_many", "log_compaction", "cascade_by_source", "contiguous_shards", "shard_sizes", "stage_worklist",
    "cell_pooling", "space_to_channel", "edge_quads", "neighbor_join", "coordinate_lookup", "trilinear_sample", "batch_layout",
    "window_permutation", "z_order_keys", "hilbert_keys", "octree_stream", "parent_deltas", "neighbor_deltas",
    "segment_reduce", "group_norm", "image_ssim", "trailing_stats", "balanced_epoch", "edge_counts", "surface_cells",
    "mesh_to_dual_grid", "texture_samples", "mesh_attributes", "tile_lists", "vxz_round_trip", "streamed_overlay",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from sparcel.plans import load_all
    from sparcel.session import local_session, release_staged

    spark = local_session(cpus, partitions=int(cpus))
    catalog, times = load_all(), {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            catalog[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
            release_staged(spark)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(sf_dir.rstrip("/"))[2:] or 0),
            }
        )
    )


if __name__ == "__main__":
    main()
