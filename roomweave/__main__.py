"""Commands: ``python -m roomweave list | run | confidence | graph``."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from roomweave.settings import Settings, read_settings


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="roomweave", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the registered queries")
    run = commands.add_parser("run", help="a query over a folder of tables, as Parquet")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("out")
    conf = commands.add_parser("confidence", help="the confidence map of a point cloud and poses, as Parquet")
    conf.add_argument("cloud")
    conf.add_argument("poses")
    conf.add_argument("out")
    conf.add_argument("--config")
    for f in fields(Settings):
        conf.add_argument(f"--{f.name}", type=type(f.default))
    graph = commands.add_parser("graph", help="the scene graph of a document of objects")
    graph.add_argument("objects")
    graph.add_argument("out")
    graph.add_argument("--metadata", help="a document with pct_medium")
    return top


def confidence(spark: SparkSession, cloud: str, poses: str, settings: Settings):
    """(i, j, k, confidence) from a PLY file and a pose document."""
    from roomweave.operators import voxels
    from roomweave.sources import ply
    from roomweave.sources.poses import read_pose_json

    points = ply.coloured(ply.read_ply(spark, cloud), least=1).select("x", "y", "z")
    shape = voxels.grid(points, settings.voxel_size)
    m = lambda i, j: F.col("cam_to_world")[i][j]
    cameras = read_pose_json(spark, poses).select(*(m(k, 3).alias(c) for k, c in enumerate("xyz")), *(m(k, 2).alias(f"f{c}") for k, c in enumerate("xyz")))
    covered = voxels.coverage(cameras, shape, settings.voxel_size, settings.camera_range)
    return voxels.confidence(voxels.density(points, shape, settings.voxel_size), covered, settings.density_weight, settings.coverage_weight)


def graph(spark: SparkSession, objects: str, metadata: str | None):
    """One row with the document of the scene graph."""
    from roomweave.operators import scene

    nodes = scene.make_nodes(scene.read_objects(spark, objects)).checkpoint()
    share = scene.read_share(spark, metadata) if metadata else 0.0
    return scene.document(nodes, scene.edges(scene.flat(nodes)), scene.summary(nodes, share))


def main(words: list[str] | None = None) -> None:
    args = parser().parse_args(words)
    from roomweave.plans.queries import QUERIES

    if args.command == "list":
        print("\n".join(QUERIES))
        return
    spark = SparkSession.builder.appName("roomweave").getOrCreate()
    from roomweave.storage import set_checkpoint_dir

    set_checkpoint_dir(spark)
    if args.command == "run":
        QUERIES[args.name](spark, args.tables).write.parquet(args.out)
    elif args.command == "confidence":
        settings = read_settings(args.config, {f.name: getattr(args, f.name) for f in fields(Settings)})
        confidence(spark, args.cloud, args.poses, settings).write.parquet(args.out)
    else:
        from roomweave.sinks.documents import write_document

        write_document(graph(spark, args.objects, args.metadata), args.out)


if __name__ == "__main__":
    main()
