"""Fetching of public reference data, with a network of our own."""

import zipfile

import pytest

from hushgrain.sources import fetch


class Net:
    def __init__(self, pages=None, there=()):
        self.pages, self.there, self.asked = pages or {}, set(there), []

    def page(self, url):
        self.asked.append(url)
        return self.pages[url]

    def status(self, url):
        self.asked.append(url)
        return None if "down" in self.there else 200 if url in self.there else 404

    def download(self, url, to):
        self.asked.append(url)
        with open(to, "w") as f:
            f.write(url)
        return to

    def fetcher(self, folder, **k):
        return fetch.Fetcher(str(folder), page=self.page, status=self.status, download=self.download, environ=k.pop("environ", {}), **k)


LATEST = fetch.ADDRESSES["gencode_latest"]


def test_cache_comes_first(tmp_path):
    """What is cached is taken without the network; the newest of several."""
    for n in ("gencode.v44.annotation.gtf.gz", "gencode.v47.annotation.gtf.gz", "atlas.clusters.3.0.GRCh38.GENCODE_42.bed.gz", fetch.POLYADB_NAME, fetch.FANTOM5_NAME, "10x_whitelist_v4.txt.gz"):
        (tmp_path / n).write_text("x")
    net = Net()
    f = net.fetcher(tmp_path, offline=True)
    r = fetch.references(f, polya_db="both", whitelist_db="10x_v4")
    assert r.gtf.endswith("v47.annotation.gtf.gz") and r.gtf_version == 47 and r.polya_version == 42 and len(r.polya_sites) == 2 and r.tss_sites[0].endswith(fetch.FANTOM5_NAME) and r.whitelist.endswith("v4.txt.gz")
    assert fetch.references(f, gtf_version=44).gtf_version == 44
    assert net.asked == [] and r.sources["gtf"] == "fetched"


def test_offline_without_cache(tmp_path):
    f = Net().fetcher(tmp_path, offline=True)
    for get in (f.gencode, lambda: f.gencode(42), f.polyasite, f.polyadb, f.fantom5, lambda: f.whitelist("10x_v3")):
        with pytest.raises(FileNotFoundError):
            get()
    with pytest.raises(ValueError):
        f.whitelist("10x_v9")


def test_latest_and_release(tmp_path):
    release = fetch.ADDRESSES["gencode_release"].format(45)
    net = Net({LATEST: '<a href="gencode.v48.annotation.gtf.gz"> gencode.v9.annotation.gtf.gz'}, {release})
    assert net.fetcher(tmp_path / "a").gencode().endswith("gencode.v48.annotation.gtf.gz") and net.asked[-1] == LATEST + "gencode.v48.annotation.gtf.gz"
    assert net.fetcher(tmp_path / "b").gencode(45).endswith("gencode.v45.annotation.gtf.gz")
    with pytest.raises(FileNotFoundError):
        net.fetcher(tmp_path / "b").gencode(46)


def test_atlas_is_probed_downwards(tmp_path):
    url = fetch.ADDRESSES["polyasite3"]
    net = Net({LATEST: "gencode.v45.annotation.gtf.gz"}, {url.format(43)})
    assert net.fetcher(tmp_path / "a").polyasite().endswith("GENCODE_43.bed.gz")
    assert [x for x in net.asked if "atlas" in x][:3] == [url.format(v) for v in (45, 44, 43)]
    with pytest.raises(FileNotFoundError):
        Net().fetcher(tmp_path / "b").polyasite(44)
    with pytest.raises(ConnectionError):
        Net(there={"down"}).fetcher(tmp_path / "c").polyasite(44)


def test_site_table_becomes_intervals(tmp_path):
    class Zip(Net):
        def download(self, url, to):
            with zipfile.ZipFile(to, "w") as z:
                z.writestr(fetch.POLYADB_TABLE, "x\tPAS_ID\n1\tchr1:+:100\n2\tbad\n3\tchrX:-:7\n")
            return to

    assert open(Zip().fetcher(tmp_path).polyadb()).read() == "chr1\t99\t100\nchrX\t6\t7\n"


def test_addresses_can_be_replaced(tmp_path):
    net = Net()
    f = net.fetcher(tmp_path, environ={"HUSHGRAIN_FANTOM5_CAGE_URL": "http://mirror/x.bed.gz", "HUSHGRAIN_TENX_WHITELIST_V3_URL": ""})
    f.fantom5()
    assert net.asked == ["http://mirror/x.bed.gz"] and f.log
    f.whitelist("10x_v3")
    assert net.asked[-1] == fetch.ADDRESSES["tenx_whitelist_v3"]


def test_given_files_win(tmp_path):
    r = fetch.references(Net().fetcher(tmp_path, offline=True), gtf="my.v3.gtf", polya_sites=["a.bed", "b.bed"], tss_db="none", whitelist="w.txt")
    assert (r.gtf, r.polya_sites, r.tss_sites, r.whitelist) == ("my.v3.gtf", ["a.bed", "b.bed"], [], "w.txt") and r.sources["polya"] == "given"
