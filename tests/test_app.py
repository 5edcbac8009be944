"""The application surface over saved tables, and pictures read by Spark."""

import datetime as dt
import hashlib
import shutil

import numpy as np
import pytest

from folio.app import App, data_dir
from folio.operators import previews
from folio.schema import TABLES, Catalogue
from folio.sources import images, tables

T0 = dt.datetime(2026, 9, 9, 12)


@pytest.fixture
def app(spark, tmp_path):
    content = b"some content"
    h = hashlib.sha256(content).hexdigest()
    build = lambda n, rows: spark.createDataFrame(rows, TABLES[n])
    blank = tables.empty(spark)
    c = Catalogue(**{
        **blank.__dict__, "assets": build("assets", [(1, "a.psd", T0, T0)]),
        "versions": build("versions", [(1, 1, h, 12, T0, T0, "/w/a.psd", "/w/a.psd", True, None, False), (2, 1, "x", 9, T0 + dt.timedelta(hours=1), T0, "/w/a.psd", "/w/a.psd", False, T0, False)]),
        "observed_files": build("observed_files", [("/w/a.psd", 1, h, 12, T0, T0, T0), ("/w/a final.psd", 1, "y", 12, T0, T0, T0)]),
        "files": build("files", [(h, 12, 1)]), "chunks": build("chunks", [(h, 12, 1)]), "file_chunks": build("file_chunks", [(h, 0, h)]),
    })
    base = str(tmp_path / "home")
    tables.save(c, base, 0)
    yield App(spark, base, lambda: T0 + dt.timedelta(days=2)), spark.createDataFrame([(h, content)], TABLES["chunk_data"])
    shutil.rmtree(base)


def test_a_user_s_day(app):
    a, data = app
    assert a.status().first().asDict() == {"assets": 1, "versions": 2, "open_tickets": 0, "to_review": 0, "folders": 0, "problems": 0}
    assert a.list_assets().first()["version_id"] == 2 and a.get_asset(1)["timeline"].count() == 2
    with pytest.raises(KeyError):
        a.get_asset(9)
    assert (a.open_version(1), a.open_version(2)) == ("live", "gone")
    assert a.export_version(1, data) == ("a (2026-09-09 12.00).psd", b"some content")
    with pytest.raises(ValueError):
        a.export_version(2, data)
    a.choose_folder("/w/")
    a.pin_version(1, True)
    a.open_ticket(1, "waiting_on_them", "colours?", "Bo")
    with pytest.raises(KeyError):
        a.open_ticket(9, "waiting_on_me", "x")
    assert a.waiting_on_them().first()["age"] == "baru saja" and a.waiting_on_me().isEmpty() and a.review_inbox().isEmpty()
    a.close_ticket(1)
    assert a.waiting_on_them().isEmpty() and a.tickets_for_asset(1).first()["status"] == "closed"
    a.reopen_ticket(1)
    a.detach_file("/w/a final.psd")
    assert a.tables().assets.count() == 2 and a.explain_grouping("/w/a.psd", "/w/a final.psd").first()["decision"] == "apart"
    a.remove_folder("/w")
    assert a.status().first()["folders"] == 0 and a.tables().versions.where("pinned").count() == 1 and a.reveal_data_dir() == a.base and a.build_info()["schema"] == 9


def test_data_dir():
    assert data_dir({"FOLIO_HOME": "/x"}) == "/x" and data_dir({"HOME": "/h"}) == "/h/.local/share/folio"


def test_spark_reads_pictures(spark, tmp_path):
    p = np.random.default_rng(0).integers(0, 256, (12, 20, 4), dtype=np.uint8)
    p[..., 3] = 255
    (tmp_path / "a.png").write_bytes(previews.encode_png(p))
    (tmp_path / "b.png").write_bytes(b"not a picture")
    got = images.pictures(spark, str(tmp_path)).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["width"], r["height"], r["phash"]) for r in got] == [("a.png", 20, 12, previews.phash(p))]
    assert (previews.decode_png(got[0]["data"]) == p).all()
