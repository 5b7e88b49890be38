"""Commits of a store: numbered JSON files, each written once and never replaced.

A commit file appears whole or not at all: it is written under a temporary
name and then moved to its number, which fails if the number is taken.  Of
two writers that start from one state the second finds its number taken,
reads the new state and makes its change again, so no change is lost.  The
highest number is the state.  Files that cannot be read are errors, never an
empty store.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

FOLDER = "_commits"
TRIES = 50


class Taken(RuntimeError):
    """Another writer has committed this version."""


def _at(spark: SparkSession, base: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{FOLDER}")
    return jvm, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def state(spark: SparkSession, base: str) -> dict | None:
    """The body of the last commit; None if there never was one."""
    jvm, folder, fs = _at(spark, base)
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    names = sorted(n for n in names if n.startswith("v") and n.endswith(".json"))
    if not names:
        return None
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, names[-1]))
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def _publish(jvm, fs, conf, draft, final) -> None:
    """Move the draft to its number; Taken if the number is there already."""
    if fs.getScheme() == "file":  # a link is made whole or not at all, and never over a file that is there
        local = lambda p: unquote(urlparse(p.toString()).path)
        try:
            os.link(local(draft), local(final))
        except FileExistsError:
            raise Taken(final.getName()) from None
        finally:
            fs.delete(draft, False)
        return
    none = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, final, none)
    except Exception as e:
        if fs.exists(final):
            fs.delete(draft, False)
            raise Taken(final.getName()) from e
        raise


def commit(spark: SparkSession, base: str, version: int, body: dict) -> dict:
    """Make ``body`` the commit of this number; raises Taken if another writer has it."""
    jvm, folder, fs = _at(spark, base)
    fs.mkdirs(folder)
    draft = jvm.org.apache.hadoop.fs.Path(folder, f".draft-{uuid.uuid4().hex}")
    final = jvm.org.apache.hadoop.fs.Path(folder, f"v{version:016d}.json")
    body = {**body, "version": version}
    out = fs.create(draft, False)
    try:
        out.write(json.dumps(body).encode())
    finally:
        out.close()
    _publish(jvm, fs, spark.sparkContext._jsc.hadoopConfiguration(), draft, final)
    return body


def change(spark: SparkSession, base: str, make: Callable[[dict | None], dict | None], tries: int = TRIES) -> dict | None:
    """Commit what ``make`` makes of the state, again on the newer state as long as others come first.

    ``make`` may write files of its own names; it returns the new body, or
    None where there is nothing to do.
    """
    for _ in range(tries):
        now = state(spark, base)
        body = make(now)
        if body is None:
            return now
        try:
            return commit(spark, base, (now["version"] if now else 0) + 1, body)
        except Taken:
            continue
    raise Taken(f"{base}: other writers came first {tries} times")
