"""Schemas of the literature data model."""

from __future__ import annotations

from pyspark.sql import types as T

PARTIAL_DATE = "struct<value:string,precision:string,source:string>"

PAPER_DDL = f"""
id string, journalId string, doi string, pii string, aliases array<string>, title string, authors array<string>,
abstract string, abstractSource string, keywords array<string>, articleType string, url string, volume string,
issue string, pages string, publishedOnline {PARTIAL_DATE}, publishedIssue {PARTIAL_DATE},
publicationDate {PARTIAL_DATE}, firstSeenAt string, updatedAt string,
relevance struct<topic:string,method:string,confidence:string,reason:string,evidence:array<string>,reviewedAt:string,reviewedFingerprint:string>,
summary string, summarySource string, summaryGeneratedAt string,
oaLocations array<struct<url:string,pdfUrl:string,hostType:string,version:string,license:string,isOa:boolean,source:string>>,
licenses array<struct<doi:string,url:string,appliesTo:string,start:{PARTIAL_DATE},source:string,sourceUrl:string,fetchedAt:string>>,
abstractRetrieval struct<checkedAt:string,status:string,errors:array<string>>,
publicContent struct<abstract:string,license:string,licenseSource:string>,
pdf struct<status:string,path:string,sourceUrl:string,sha256:string,bytes:bigint,license:string,version:string,error:string,attemptedAt:string>,
milestones array<struct<kind:string,observedAt:string,date:string,runId:string>>,
provenance array<struct<source:string,url:string,fetchedAt:string>>
"""

JOURNAL_DDL = "id string, name string, shortName string, issn string, publisher string, url string, feeds array<string>"
HEALTH_DDL = "journalId string, status string, checkedAt string, lastSuccessAt string, discovered int, errors array<string>"

VISIBLE_TOPICS = ("both", "learning-analytics", "ai")


def paper_schema() -> T.StructType:
    return T.StructType.fromDDL(PAPER_DDL)
