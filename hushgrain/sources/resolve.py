"""Where reference data come from: explicit paths, addresses, caches.

What is published where is in :mod:`hushgrain.sources.fetch`.
"""

from __future__ import annotations

import hashlib
import os
import re
import urllib.request

#: Environment variables of this form replace an address.
OVERRIDE = "HUSHGRAIN_{}_URL"


def address(key: str, default: str, environ: dict[str, str] | None = None) -> str:
    """The default address, unless the environment replaces it with a non-empty one."""
    return (os.environ if environ is None else environ).get(OVERRIDE.format(key.upper())) or default


def choose(explicit: str | list[str] | None, *, version: str | None = None, by_version=None, cached: str | None = None, fetch=None, offline: bool = False) -> str | list[str]:
    """An explicit path, else a version's, else the cached one, else what ``fetch`` brings; raises if offline with none."""
    if explicit:
        return explicit
    if version is not None and by_version is not None:
        return by_version(version)
    if cached:
        return cached
    if offline or fetch is None:
        raise FileNotFoundError("nothing cached, and downloads are off")
    return fetch()


def choose_sites(explicit: str | list[str] | None, db: str | None, fetchers: dict) -> list[str]:
    """Site lists: the explicit ones, else of one database or ``both``."""
    if explicit:
        return [explicit] if isinstance(explicit, str) else list(explicit)
    return [fetchers[n]() for n in (list(fetchers) if db == "both" else [db] if db in fetchers else [])]


def version_of(name: str, pattern: str = r"[vV](\d+)") -> int | None:
    m = re.search(pattern, os.path.basename(name))
    return int(m.group(1)) if m else None


def newest_name(names: list[str], pattern: str) -> str | None:
    """Of the names that match ``pattern`` that with the highest version (its group)."""
    found = [(int(m.group(1)), n) for n in names if (m := re.search(pattern, n))]
    return max(found)[1] if found else None


def newest(folder: str, pattern: str) -> str | None:
    """The cached file of the highest version that matches ``pattern``."""
    name = newest_name(os.listdir(folder) if os.path.isdir(folder) else [], pattern)
    return os.path.join(folder, name) if name else None


def probe(url: str, timeout: float = 15) -> int | None:
    """The status of a HEAD request; null where the network fails, so that this differs from 404."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as r:
            return r.status
    except urllib.error.HTTPError as e:
        return e.code
    except OSError:
        return None


def download(url: str, to: str, open_=urllib.request.urlopen) -> str:
    """Stream to a temporary name, check the size, rename."""
    part = to + ".tmp"
    try:
        with open_(url) as r, open(part, "wb") as f:
            want, size = r.headers.get("Content-Length"), 0
            while chunk := r.read(1 << 20):
                size += f.write(chunk)
        if want is not None and int(want) != size:
            raise OSError(f"{url}: {size} of {want} bytes")
        os.replace(part, to)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return to


def latest_version(first: int, last: int, url: str, status=probe) -> int | None:
    """The highest version whose address exists, from ``first`` down; raises if the network fails throughout."""
    seen = []
    for v in range(first, last - 1, -1):
        s = status(url.format(v))
        if s == 200:
            return v
        seen.append(s)
    if seen and all(s is None for s in seen):
        raise ConnectionError("the network can't be reached")
    return None


def cache_key(paths: list[str], *settings: str, spark=None) -> str:
    """Changes with any file's size, time or first 64 KB, and with any setting.  Of files on a shared store (with ``spark``) size and time."""
    h = hashlib.md5()
    for p in paths:
        if spark is not None and "://" in p:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            st = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
            h.update(f"{p}:{st.getModificationTime()}:{st.getLen()}".encode())
            continue
        st = os.stat(p)
        with open(p, "rb") as f:
            h.update(f"{p}:{st.st_mtime_ns}:{st.st_size}".encode() + f.read(1 << 16))
    h.update("\0".join(settings).encode())
    return h.hexdigest()


def cached(spark, folder: str, key: str, build, no_cache: bool = False):
    """Tables ``{name: DataFrame}`` kept as Parquet under ``folder/key``; built and written if not there.

    The list of names is written last, through the tables' own file system, so that what an
    interrupted run left is built anew.
    """
    if no_cache:
        return build()
    base = f"{folder.rstrip('/')}/{key}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/complete/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        built = build()
        for name, df in built.items():
            df.write.mode("overwrite").parquet(f"{base}/{name}")
        spark.createDataFrame([(name,) for name in built], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/complete")
    names = [r.value for r in spark.read.text(f"{base}/complete").collect()]
    return {name: spark.read.parquet(f"{base}/{name}") for name in names}
