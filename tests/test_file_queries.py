"""How the queries on real files spread their work; what they return is graded against SQL."""

from __future__ import annotations

import uuid
from pathlib import Path

import pytest

from sealroute.plans import decrypt_job
from sealroute.queries import file_jobs

SF = "/root/testdata/sf0.001"


def marked(frame, folder):
    """The frame in one task that leaves a file in ``folder`` each time it runs."""
    def run(batches, to=str(folder)):
        with open(f"{to}/{uuid.uuid4().hex}", "w"):
            yield from batches

    return frame.coalesce(1).mapInArrow(run, frame.schema)


@pytest.mark.parametrize("name", ["payload_read", "encrypt_outputs"])
def test_a_listing_is_walked_once(spark, tmp_path, monkeypatch, name):
    """A listing that is opened is also counted, which must not walk the folders again."""
    walks = tmp_path / "walks"
    walks.mkdir()

    for lister in ("list_folders", "list_tree"):
        plain = getattr(file_jobs, lister)
        monkeypatch.setattr(file_jobs, lister, lambda *args, plain=plain, **options: marked(plain(*args, **options), walks))
    assert file_jobs.QUERIES[name][0](spark, SF).count() > 0
    assert len(list(walks.iterdir())) == 1


def test_no_tree_is_walked_by_one_task(spark, monkeypatch):
    """Whole trees are listed in rounds; ``list_folders`` gives a tree to one task."""
    plain = file_jobs.list_folders

    def flat(*args, recursive=False, **options):
        assert not recursive
        return plain(*args, **options)

    monkeypatch.setattr(file_jobs, "list_folders", flat)
    for name in ("job_commits", "decrypt_outputs", "encrypt_errors", "encrypt_outputs"):
        assert file_jobs.QUERIES[name][0](spark, SF).count() > 0


def test_contested_files_are_moved_once(spark, tmp_path, monkeypatch):
    """Routing reads what became of contested destinations several times, which must not move the files again."""
    plain = decrypt_job.apply_moves

    def counted(rows, source, target, replace, output, **options):
        moved = plain(rows, source, target, replace, output, **options)
        return marked(moved, tmp_path) if output == "publish_error" else moved

    monkeypatch.setattr(decrypt_job, "apply_moves", counted)
    assert file_jobs.QUERIES["decrypt_outputs"][0](spark, SF).count() > 0
    assert len(list(tmp_path.iterdir())) == 1


def test_encrypt_outputs_takes_whole_requests_in_rounds(spark, monkeypatch):
    """The files and folders of all requests at once would fill a disk; a round has a bounded number of them."""
    whole = sorted(map(str, file_jobs.QUERIES["encrypt_outputs"][0](spark, SF).select("path", "length", "sha256").collect()))
    plain, runs, roots = file_jobs.encrypt_files, [], []

    def counted(requests, *args, **options):
        rows = requests.select("request_id", "root").collect()
        runs.append([row.request_id for row in rows])
        roots.append(Path(rows[0].root))
        # What an earlier round made has gone, and only this round's requests have files.
        assert not any(root.exists() for root in roots[:-1])
        held = {"/".join(path.relative_to(roots[-1] / "staging").parts[:2]) for path in roots[-1].glob("staging/*/*")}
        assert held == set(runs[-1])
        return plain(requests, *args, **options)

    monkeypatch.setattr(file_jobs, "encrypt_files", counted)
    monkeypatch.setattr(file_jobs, "ROUND_ENTRIES", 700)
    found = file_jobs.QUERIES["encrypt_outputs"][0](spark, SF).select("path", "length", "sha256").collect()
    assert sorted(map(str, found)) == whole
    assert len(runs) > 1 and len(set(sum(runs, []))) == len(sum(runs, []))
    assert max(map(len, runs)) < len(sum(runs, []))
