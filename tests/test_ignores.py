"""Ignore files of every folder, the exclude file of version control, and symbolic links, on trees of their own."""

import pytest

from docquery.sources import files


def tree(root, names, ignores=None):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"# {name}\n")
    for name, lines in (ignores or {}).items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("\n".join(lines) + "\n")
    return root


def found(spark, root, **options):
    return {r.rel_path for r in files.scan(spark, str(root), **options).collect()}


def test_the_deepest_last_rule_decides(spark, tmp_path):
    names = ["a.md", "draft.md", "x/a.md", "x/draft.md", "x/keep.md", "x/y/draft.md", "x/y/z/a.md", "out/a.md", "out/deep/b.md", "w/only.md", "w/v/only.md", "w/t1.md", "w/tx.md"]
    ignores = {
        ".gitignore": ["# drafts", "draft.md", "keep.md", "out/"], "x/.gitignore": ["!draft.md", "/y/z", "!keep.md", "../a.md"], "x/y/.gitignore": ["draft.md"],
        "out/.gitignore": ["!*"], "w/.gitignore": ["/only.md", "t[0-9].md"],
    }
    root = tree(tmp_path, names, ignores)
    # a rule below takes back what the root leaves out, but nothing in a folder that is out
    assert found(spark, root) == {"a.md", "x/a.md", "x/draft.md", "x/keep.md", "w/v/only.md", "w/tx.md"}
    assert found(spark, root, patterns=["x/", "!/draft.md"]) == {"a.md", "draft.md", "w/v/only.md", "w/tx.md"}
    # the engine's own ignore file is stronger, wherever it lies
    (root / ".docqueryignore").write_text("x/draft.md\n!out/\n!x/y/draft.md\n")
    assert found(spark, root) == {"a.md", "x/a.md", "x/keep.md", "x/y/draft.md", "out/a.md", "out/deep/b.md", "w/v/only.md", "w/tx.md"}
    with pytest.raises(ValueError):
        files.scan(spark, str(root), patterns=["../a.md"])


def test_exclude_files_are_weakest(spark, tmp_path):
    plain = tree(tmp_path / "plain", ["a.md", "b.md", "s/b.md"], {".git/info/exclude": ["b.md"], "s/.gitignore": ["!b.md"]})
    assert found(spark, plain) == {"a.md", "s/b.md"}
    tree(tmp_path / "main", ["a.md"], {".git/info/exclude": ["/b.md"], ".git/worktrees/w/commondir": ["../.."]})
    linked = tree(tmp_path / "linked", ["a.md", "b.md", "s/b.md"], {".git": [f"gitdir: {tmp_path}/main/.git/worktrees/w"]})
    assert found(spark, linked) == {"a.md", "s/b.md"}


def test_symbolic_links_are_not_followed(spark, tmp_path):
    other = tree(tmp_path / "other", ["secret.md"])
    root = tree(tmp_path / "root", ["a.md", "s/b.md"])
    (root / "link.md").symlink_to(other / "secret.md")
    (root / "folder").symlink_to(other)
    (root / "again").symlink_to(root / "s")
    assert found(spark, root) == {"a.md", "s/b.md"}
