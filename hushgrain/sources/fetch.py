"""Public reference data: annotation, poly-A sites, transcription starts, barcode lists.

Each is looked for in a cache folder first; only what is not there is downloaded, and with
``offline`` that raises.  The network is a pair of functions that tests replace.
"""

from __future__ import annotations

import io
import os
import re
import urllib.request
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field

from hushgrain.sources import resolve

# Where the data are published; ``{}`` stands for a version.  Environment variables of the form
# ``HUSHGRAIN_<KEY>_URL`` replace them.
ADDRESSES = {
    "gencode_latest": "https://ftp.ebi.ac.uk/pub/databases/gencode/Gencode_human/latest_release/",
    "gencode_release": "https://ftp.ebi.ac.uk/pub/databases/gencode/Gencode_human/release_{0}/gencode.v{0}.annotation.gtf.gz",
    "polyasite3": "https://polyasite.unibas.ch/download/atlas/3.0/GRCh38.GENCODE_{0}/atlas.clusters.3.0.GRCh38.GENCODE_{0}.bed.gz",
    "polyadb4_zip": "https://exon.apps.wistar.org/polya_db/v4/download/4.1/HumanPas.zip",
    "fantom5_cage": "https://fantom.gsc.riken.jp/5/datafiles/reprocessed/hg38_latest/extra/CAGE_peaks/hg38_fair+new_CAGE_peaks_phase1and2.bed.gz",
    "tenx_whitelist_v3": "https://github.com/10XGenomics/cellranger/raw/master/lib/python/cellranger/barcodes/3M-february-2018.txt.gz",
    "tenx_whitelist_v4": "https://github.com/10XGenomics/cellranger/raw/master/lib/python/cellranger/barcodes/3M-3pgex-may-2023.txt.gz",
}
# Names in the cache, the first version of the site atlas, the table within the site archive.
GENCODE_NAME = r"^gencode\.v(\d+)\.annotation\.gtf\.gz$"
POLYASITE_NAME = r"^atlas\.clusters\.3\.0\.GRCh38\.GENCODE_(\d+)\.bed\.gz$"
POLYASITE_FIRST = 42
POLYADB_TABLE, POLYADB_NAME = "HumanPas/hg38.PAS.main.tsv", "polyadb4.hg38.PAS.main.bed"
FANTOM5_NAME = "fantom5.hg38.CAGE_peaks.bed.gz"
WHITELIST_NAMES = {"10x_v3": ("tenx_whitelist_v3", "10x_whitelist_v3.txt.gz"), "10x_v4": ("tenx_whitelist_v4", "10x_whitelist_v4.txt.gz")}


def _page(url: str) -> str:
    with urllib.request.urlopen(url, timeout=60) as r:
        return r.read().decode(errors="replace")


@dataclass
class Fetcher:
    """Brings files into ``folder`` and returns their paths."""

    folder: str
    offline: bool = False
    environ: dict[str, str] | None = None
    page: Callable[[str], str] = _page
    status: Callable[[str], int | None] = resolve.probe
    download: Callable[[str, str], str] = resolve.download
    log: list[str] = field(default_factory=list)

    def _at(self, key: str) -> str:
        url = resolve.address(key, ADDRESSES[key], self.environ)
        if url != ADDRESSES[key]:
            self.log.append(f"{key} from {url}")
        return url

    def _have(self, name: str) -> str | None:
        path = os.path.join(self.folder, name)
        return path if os.path.exists(path) and os.path.getsize(path) else None

    def _get(self, url: Callable[[], str], name: str | None = None, what: str = "") -> str:
        """The cached file, else the one at an address that is only asked for then."""
        if name is not None and (path := self._have(name)):
            return path
        if self.offline:
            raise FileNotFoundError(f"{what or name} is not cached, and downloads are off; give the file itself or run once with a network")
        at = url()
        os.makedirs(self.folder, exist_ok=True)
        return self.download(at, os.path.join(self.folder, name or at.rsplit("/", 1)[-1]))

    def gencode(self, version: int | None = None) -> str:
        """The annotation of a release; without one the newest cached, else the latest published."""
        if version is not None:

            def release() -> str:
                url = self._at("gencode_release").format(version)
                if self.status(url) != 200:
                    raise FileNotFoundError(f"no annotation of release {version} at {url}")
                return url

            return self._get(release, f"gencode.v{version}.annotation.gtf.gz")
        if newest := resolve.newest(self.folder, GENCODE_NAME):
            return newest
        return self._get(lambda: self._at("gencode_latest") + self._latest_name(), what="an annotation")

    def _latest_name(self) -> str:
        names = re.findall(GENCODE_NAME.strip("^$"), page := self.page(self._at("gencode_latest")))
        if not names:
            raise FileNotFoundError(f"no annotation is listed in a page of {len(page)} characters")
        return f"gencode.v{max(map(int, names))}.annotation.gtf.gz"

    def polyasite(self, newest_release: int | None = None) -> str:
        """The site atlas of the highest annotation release that has one, from ``newest_release`` down."""
        if cached := resolve.newest(self.folder, POLYASITE_NAME):
            return cached

        def url() -> str:
            first = newest_release or resolve.version_of(self._latest_name())
            template = self._at("polyasite3")
            version = resolve.latest_version(first, POLYASITE_FIRST, template, self.status)
            if version is None:
                raise FileNotFoundError(f"no atlas of releases {POLYASITE_FIRST} to {first} at {template}")
            return template.format(version)

        return self._get(url, what="a poly-A site atlas")

    def polyadb(self) -> str:
        """The site table of the archive as intervals of one base."""
        if path := self._have(POLYADB_NAME):
            return path
        archive = self._get(lambda: self._at("polyadb4_zip"), "polyadb4.zip", "a poly-A site table")
        to = os.path.join(self.folder, POLYADB_NAME)
        with zipfile.ZipFile(archive) as z, io.TextIOWrapper(z.open(POLYADB_TABLE)) as f, open(to + ".tmp", "w") as out:
            column = f.readline().rstrip("\n").split("\t").index("PAS_ID")
            for line in f:
                contig, _, pos = (line.rstrip("\n").split("\t")[column].split(":") + ["", ""])[:3]
                if pos.isdigit():
                    out.write(f"{contig}\t{int(pos) - 1}\t{pos}\n")
        os.replace(to + ".tmp", to)
        os.remove(archive)
        return to

    def fantom5(self) -> str:
        return self._get(lambda: self._at("fantom5_cage"), FANTOM5_NAME)

    def whitelist(self, chemistry: str) -> str:
        """The barcode list of ``10x_v3`` or ``10x_v4``."""
        if chemistry.lower() not in WHITELIST_NAMES:
            raise ValueError(f"no barcode list of {chemistry}; there are {sorted(WHITELIST_NAMES)}")
        key, name = WHITELIST_NAMES[chemistry.lower()]
        return self._get(lambda: self._at(key), name)


@dataclass
class References:
    """The files of a run, with the releases they were made for where their names tell."""

    gtf: str
    polya_sites: list[str]
    tss_sites: list[str]
    whitelist: str | None
    sources: dict[str, str]

    @property
    def gtf_version(self) -> int | None:
        return resolve.version_of(self.gtf)

    @property
    def polya_version(self) -> int | None:
        found = [v for p in self.polya_sites if (v := resolve.version_of(p, r"GENCODE[_.](\d+)"))]
        return found[0] if found else None


def references(fetcher: Fetcher, gtf: str | None = None, gtf_version: int | None = None, polya_sites: list[str] | None = None, polya_db: str = "polyasite3", tss_sites: list[str] | None = None, tss_db: str = "fantom5", whitelist: str | None = None, whitelist_db: str = "none") -> References:
    """Given files first, then cached or downloaded ones of the databases named; ``none`` names none."""
    made = {"gtf": gtf, "polya": polya_sites, "tss": tss_sites, "whitelist": whitelist}
    sources = {k: "given" if v else "fetched" for k, v in made.items()}
    found = resolve.choose(gtf, version=gtf_version, by_version=fetcher.gencode, fetch=fetcher.gencode)
    hint = resolve.version_of(found) if not gtf else None
    polya = {"polyasite3": lambda: fetcher.polyasite(hint), "polyadb4": fetcher.polyadb}
    return References(found, resolve.choose_sites(polya_sites, polya_db, polya), resolve.choose_sites(tss_sites, tss_db, {"fantom5": fetcher.fantom5}), whitelist or (None if whitelist_db == "none" else fetcher.whitelist(whitelist_db)), sources)
