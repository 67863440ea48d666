"""Capture folders as tables: poses, intrinsics, depth and confidence pixels, photos, archives, fingerprints."""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POSE_COLUMNS = ("ts", "frame_idx", "tx", "ty", "tz", "qx", "qy", "qz", "qw", "fx", "fy", "cx", "cy")
PHOTO_SUFFIXES = ("jpg", "jpeg", "png", "heic", "tif", "tiff")
PHOTOS_PER_ROOM = 8


def capture_root(path: str | Path) -> Path:
    """The folder that holds odometry.csv: the given one, or its only child that does."""
    root = Path(path)
    if (root / "odometry.csv").is_file():
        return root
    inner = [p for p in root.iterdir() if (p / "odometry.csv").is_file()] if root.is_dir() else []
    if len(inner) != 1:
        raise FileNotFoundError(f"no single capture below {root}")
    return inner[0]


def read_poses(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(cap, seq, ts, frame_idx, tx..tz, qx..qw, fx, fy, cx, cy) of pose files by capture.

    Columns count by position; the header is skipped. Where not all four intrinsics are given, those of
    camera_matrix.csv beside the file are used. A file without rows is an error.
    """
    out = None
    for cap, path in paths.items():
        text = spark.read.text(path).where("trim(value) <> ''").withColumn("n", F.monotonically_increasing_id())
        cells = F.transform(F.split("value", ","), lambda c: F.trim(c))
        rows = text.withColumn("seq", F.row_number().over(Window.orderBy("n")) - 2).where("seq >= 0").select("seq", cells.alias("c"))
        if not rows.limit(1).count():
            raise ValueError(f"no frames in {path}")
        at = [F.get("c", F.lit(i)).alias(name) for i, name in enumerate(POSE_COLUMNS)]
        one = rows.select(F.lit(cap).alias("cap"), "seq", *at)
        one = one.select("cap", F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("long" if c == "frame_idx" else "double").alias(c) if i < 9 else F.nullif(F.col(c), F.lit("")).cast("double").alias(c) for i, c in enumerate(POSE_COLUMNS)])
        k = spark.read.text(path.rsplit("/", 1)[0] + "/camera_matrix.csv") if one.where("fx is null or fy is null or cx is null or cy is null").limit(1).count() else None
        if k is not None:
            m = [[float(x) for x in r["value"].split(",")] for r in k.limit(3).collect()]
            given = F.col("fx").isNotNull() & F.col("fy").isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull()
            one = one.withColumns({c: F.when(given, F.col(c)).otherwise(F.lit(v)) for c, v in (("fx", m[0][0]), ("fy", m[1][1]), ("cx", m[0][2]), ("cy", m[1][2]))})
        out = one if out is None else out.unionByName(one)
    return out


def decode_png(raw: bytes) -> np.ndarray:
    """Grey PNG of 8 or 16 bits, not interlaced."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, head = 8, b"", None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    w, h, depth, colour, _, _, interlace = head
    if colour or interlace or depth not in (8, 16):
        raise ValueError("only plain grey images of 8 or 16 bits")
    step = depth // 8
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, np.int32)
    for r in range(h):
        method, x = lines[r, 0], lines[r, 1:].astype(np.int32)
        if method == 2:
            x = (x + above) & 255
        elif method:
            for i in range(len(x)):
                a = x[i - step] if i >= step else 0
                b, c = above[i], above[i - step] if i >= step else 0
                if method == 1:
                    more = a
                elif method == 3:
                    more = (a + b) // 2
                else:
                    near = a + b - c
                    more = min((abs(near - a), 0, a), (abs(near - b), 1, b), (abs(near - c), 2, c))[2]
                x[i] = (x[i] + more) & 255
        out[r], above = x, x
    return out.view(">u2").astype(np.uint16) if step == 2 else out


def read_grids(spark: SparkSession, folders: dict[str, str], column: str) -> DataFrame:
    """(cap, frame_idx, v, u, column) from PNG folders by capture; the file's name is the frame index."""
    out = None
    for cap, folder in folders.items():
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
        named = files.select(F.lit(cap).alias("cap"), F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("frame_idx"), "content")
        out = named if out is None else out.unionByName(named)

    def run(batches):
        for pdf in batches:
            for cap, frame, raw in pdf.itertuples(index=False):
                img = decode_png(raw)
                v, u = np.indices(img.shape)
                yield pd.DataFrame({"cap": cap, "frame_idx": frame, "v": v.ravel(), "u": u.ravel(), column: img.ravel().astype(np.int32)})

    return out.mapInPandas(run, f"cap string, frame_idx long, v int, u int, {column} int")


def pixels(poses: DataFrame, depth: DataFrame, confidence: DataFrame | None = None) -> DataFrame:
    """Depth pixels in metres (0: none) joined with their frame's pose and confidence."""
    p = depth.withColumn("z", F.col("depth_mm") / 1000.0)
    if confidence is not None:
        p = p.join(confidence, ["cap", "frame_idx", "v", "u"], "left")
    return p.join(poses, ["cap", "frame_idx"])


def fingerprint(odometry: bytes, images: list[tuple[str, int, int]]) -> str:
    """Key of a capture's inputs from its poses and the name, size and time of each image."""
    text = "".join(f"{n}:{s}:{t}" for n, s, t in sorted(images))
    return hashlib.sha256(odometry + text.encode()).hexdigest()[:20]


def list_photos(spark: SparkSession, folder: str) -> DataFrame:
    """(room, path): photos by folder name, at most eight a room; none at all, or a capture's folder, is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    if files.where(F.col("path").endswith("/odometry.csv")).limit(1).count():
        raise ValueError("this folder is a depth capture")
    photos = files.where(kind.isin(*PHOTO_SUFFIXES)).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("room"), "path")
    if not photos.limit(1).count():
        raise ValueError("no photos found")
    crowded = photos.groupBy("room").count().where(F.col("count") > PHOTOS_PER_ROOM).limit(1).collect()
    if crowded:
        raise ValueError(f"more than {PHOTOS_PER_ROOM} photos in {crowded[0]['room']}")
    return photos


def unpack_archive(path: str | Path, work: str | Path) -> Path:
    """Unpack a ZIP into a folder named by its hash; members outside of it and symbolic links are refused. Repeats do nothing."""
    raw = Path(path).read_bytes()
    out = Path(work) / hashlib.sha256(raw).hexdigest()[:20]
    if (out / ".complete").exists():
        return out
    with zipfile.ZipFile(path) as z:
        for m in z.infolist():
            target = (out / m.filename).resolve()
            if out.resolve() not in (target, *target.parents) or (m.external_attr >> 16) & 0o170000 == 0o120000:
                raise ValueError(f"unsafe member {m.filename}")
        z.extractall(out)
    (out / ".complete").touch()
    return out
