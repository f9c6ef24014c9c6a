"""Whole commands as one plan: from the files and settings of many projects to the result."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import cleaning, packing, selection


def _configured(files: DataFrame, configs: DataFrame, tool_file: str | None, clean: bool) -> tuple[DataFrame, DataFrame]:
    """Files selected under each project's settings, and the settings, one row per project. A project
    without settings has the defaults, one whose settings are invalid is left out."""
    projects = files.select("project").distinct().join(configs, "project", "left").select("project", "json")
    config = selection.effective_config(projects)
    rules = selection.ignore_rules(selection.ignore_sources(config, files, tool_file, clean))
    valid = config.where("NOT invalid")
    kept = files.join(valid.select("project"), "project", "left_semi")
    return selection.find_files(kept, rules), valid


def clean_configured(files: DataFrame, configs: DataFrame, tool_file: str | None = None) -> DataFrame:
    """Cleaned files (see ``cleaning.clean_files``) as the settings of their project select and clean them.

    ``files`` has ``project, path, length, content``, ``configs`` has ``project, json``. Ignore lists for
    packing and cleaning and the version-control file select, then the kinds that can be cleaned;
    the project's own kept words and its choice about documentation blocks decide on comments.
    """
    found, config = _configured(files, configs, tool_file, clean=True)
    wanted = selection.extension_filter(found).join(config.select("project", "whitelist", "keep_doc"), "project")
    return cleaning.clean_files(wanted, wanted["whitelist"], wanted["keep_doc"]).drop("whitelist", "keep_doc")


def pack_configured(files: DataFrame, configs: DataFrame, fmt: str = "xml", tool_file: str | None = None) -> DataFrame:
    """The packed context (see ``packing.pack``) of the files the settings of each project select."""
    return packing.pack(_configured(files, configs, tool_file, clean=False)[0], fmt)
