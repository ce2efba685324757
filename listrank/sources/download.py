"""Raw files from a URL to a local folder: checked by digest, whole or not at all."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import urllib.request
import zipfile

CHUNK = 1 << 20

#: Where the raw data sets are, the digest of the archive, and the files that it must hold.
ARCHIVES = {
    "ratings": {
        "url": "https://files.grouplens.org/datasets/movielens/ml-25m.zip", "md5_url": "https://files.grouplens.org/datasets/movielens/ml-25m.zip.md5",
        "md5": "6b51fb2759a8657d3bfcbfc42b592ada", "folder": "ml-25m", "files": ("ratings.csv", "genome-tags.csv", "genome-scores.csv"),
    },
}
#: Files without a published digest, whose digests a run records.
FILES = {
    "reviews": (
        "https://mcauleylab.ucsd.edu/public_datasets/data/amazon_2023/raw/review_categories/Beauty_and_Personal_Care.jsonl.gz",
        "https://mcauleylab.ucsd.edu/public_datasets/data/amazon_2023/raw/meta_categories/meta_Beauty_and_Personal_Care.jsonl.gz",
    ),
}


def digest(path: str, kind: str = "sha256") -> str:
    h = hashlib.new(kind)
    with open(path, "rb") as f:
        while part := f.read(CHUNK):
            h.update(part)
    return h.hexdigest()


def fetch(url: str, path: str, expected: str | None = None, kind: str = "sha256", force: bool = False) -> str:
    """The file's digest. A file that is there and has the expected digest (or none is expected) is used again. What
    arrives is kept under another name until it is whole and its digest is right."""
    if os.path.exists(path) and not force:
        found = digest(path, kind)
        if expected is None or found == expected.lower():
            return found
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    part = path + ".part"
    with urllib.request.urlopen(url) as source, open(part, "wb") as out:
        shutil.copyfileobj(source, out, CHUNK)
    found = digest(part, kind)
    if expected is not None and found != expected.lower():
        os.remove(part)
        raise ValueError(f"{url}: {kind} is {found}, not {expected}")
    os.replace(part, path)
    return found


def unpack(archive: str, folder: str) -> list[str]:
    """Names of the files unpacked; a member that would leave the folder raises before anything is written."""
    top = os.path.realpath(folder)
    with zipfile.ZipFile(archive) as z:
        names = [n for n in z.namelist() if not n.endswith("/")]
        for n in names:
            if os.path.commonpath([top, os.path.realpath(os.path.join(top, n))]) != top:
                raise ValueError(f"{archive}: {n} lies outside the folder")
        z.extractall(top)
    return names


def data_set(name: str, folder: str, force: bool = False, archives: dict | None = None, files: dict | None = None) -> dict:
    """Fetches a data set into the folder, and returns and writes (download.json) its files' sizes and digests. An
    archive's published digest must be the pinned one, and its own; files that it lacks raise."""
    archives, files = ARCHIVES if archives is None else archives, FILES if files is None else files
    if name in archives:
        known = archives[name]
        listed = os.path.join(folder, os.path.basename(known["md5_url"]))
        fetch(known["md5_url"], listed, force=force)
        with open(listed, encoding="utf-8", errors="replace") as f:
            published = re.search(r"\b[0-9a-fA-F]{32}\b", f.read())
        if not published or published[0].lower() != known["md5"]:
            raise ValueError(f"{name}: the published digest is {published and published[0]}, not {known['md5']}")
        archive = os.path.join(folder, os.path.basename(known["url"]))
        fetch(known["url"], archive, known["md5"], "md5", force)
        paths = [os.path.join(folder, known["folder"], n) for n in known["files"]]
        if force or not all(map(os.path.exists, paths)):
            unpack(archive, folder)
        if missing := [p for p in paths if not os.path.exists(p)]:
            raise ValueError(f"{name}: the archive lacks {missing}")
    elif name in files:
        paths = [os.path.join(folder, os.path.basename(url)) for url in files[name]]
        for url, path in zip(files[name], paths, strict=True):
            fetch(url, path, force=force)
    else:
        raise ValueError(f"unknown data set {name}")
    found = {"name": name, "files": [{"path": os.path.relpath(p, folder), "bytes": os.path.getsize(p), "sha256": digest(p)} for p in paths]}
    with open(os.path.join(folder, "download.json"), "w", encoding="utf-8") as f:
        json.dump(found, f, indent=2, sort_keys=True)
    return found
