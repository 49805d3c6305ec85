"""Golden cases for the text builders with several branches."""

from pyspark.sql import functions as F

from casebook.operators import findings as FD
from casebook.operators import prompting as PR
from casebook.operators import ranking as RK


def test_technical_query_branches(spark):
    inc = spark.createDataFrame([(1, "Agent on macOS lost the JWT token for 300 machines"), (2, None), (3, "")],
                                "incident_id long, summary string")
    latest = spark.createDataFrame([(2, "Defender reports authentication failure over and over again on this host"),
                                    (3, "nothing relevant here at all but it is definitely long enough to count")],
                                   "incident_id long, latest_message string")
    q = {r.incident_id: r.technical_query for r in FD.technical_query(inc, latest).collect()}
    assert q[1] == ("Agent on macOS lost the JWT token for 300 machines "
                    "macOS JWT token authentication large scale deployment")
    assert q[2] == "Microsoft Defender authentication"
    assert q[3] == "Microsoft Defender Endpoint troubleshooting"


def test_incident_context_lines(spark):
    full = spark.createDataFrame([(7, " the mde sensor on Ubuntu needs a reset", "sum")],
                                 "incident_id long, full_content string, summary string")
    ctx = FD.incident_context(FD.rule_findings(full)).first().incident_context
    assert ctx.split("\n") == ["Incident Summary: sum", "Platforms: Ubuntu", "Components: MDE, MDE Sensor",
                               "Issue: reset required", "Incident ID: 7"]


def test_heuristic_explanation_sentences(spark):
    c = spark.createDataFrame([("policy for device-control on linux", "", "Device Control Policy",
                                "linux policy onboarding guide", 6.25)],
                              "query_text string, context string, title string, content_summary string, "
                              "llm_relevance_score double")
    e = RK.heuristic_explanation(c).first().intelligent_explanation
    # the title splits into device / control, so "device-control" is not shared
    assert e == ("Article matches incident based on technical terms: policy, linux. "
                 "Platform-specific troubleshooting guidance. Configuration and deployment guidance. "
                 "Relevance score: 6.2/10.")


def test_team_and_memory_context(spark):
    teams = spark.createDataFrame([(1, "alpha", ["escalation"], 0.25, ["net"]), (1, "beta", [], 0.75, [])],
                                  "incident_id long, team_name string, interaction_types array<string>, "
                                  "confidence double, matched_domains array<string>")
    kb = spark.createDataFrame([("beta", ["r1", "r2", "r3", "r4"], [], "c" * 120)],
                               "team_name string, responsibilities array<string>, expertise array<string>, "
                               "capabilities string")
    ctx = PR.team_context(teams, kb).first().team_context
    assert ctx.split("\n") == [
        "Teams involved: beta, alpha",
        "Team Knowledge Database:",
        "beta: Responsibilities: r1, r2, r3 | " + "c" * 100 + "...",
        "beta (unknown, confidence: 0.75)",
        "alpha (escalation, confidence: 0.25) - Expertise: net",
    ]
    prompts = spark.createDataFrame([(1, "Base", 0), (2, "Other", 3)],
                                    "incident_id long, enhanced_prompt string, examples_used int")
    hits = spark.createDataFrame([(1, 1, 10, "fixed by restart"), (1, 2, 11, "fixed by patch")],
                                 "incident_id long, rank int, memory_id long, memory_summary string")
    out = {r.incident_id: r for r in PR.append_memory_context(prompts, hits).collect()}
    assert out[1].enhanced_prompt == ("Base\n\nContext from previous similar incidents:\nPrevious similar incidents:\n"
                                      "1. Incident 10: fixed by restart\n2. Incident 11: fixed by patch\n\n"
                                      "Use this context to provide more informed and consistent analysis.")
    assert out[2].enhanced_prompt == "Other" and not out[2].memory_enhanced


def test_request_template(spark):
    c = spark.createDataFrame([("q", "ctx", "T", "S", 7.0)],
                              "query_text string, context string, title string, content_summary string, "
                              "llm_relevance_score double")
    r = PR.request_texts(c).first()
    assert "## Incident Query\nq\n\n## Incident Context\nctx" in r.scoring_request
    assert "**URL:** Unknown" in r.scoring_request and "**Relevance Score:** 7.0/10" in r.explanation_request


def test_logs_prompt_sections(spark):
    from casebook.operators import logs as LG

    keys = spark.createDataFrame([("9", "01-01", "out", "config.txt", "warn: x", "key"),
                                  ("9", "01-01", "out", "health.txt", "error here", "key")],
                                 "incident_id string, date_folder string, analyzer_folder string, file_name string, "
                                 "content string, kind string")
    nested = spark.createDataFrame([("9", "01-01", "out", "a.log", "tail", "nested")],
                                   "incident_id string, date_folder string, analyzer_folder string, file_name string, "
                                   "content string, kind string")
    gh = spark.createDataFrame([("9", 2, 0, "see https://github.com/o/r"), ("9", 1, 0, "no link"),
                                ("9", 3, 0, "later github.com/x")], "incident_id string, ts int, pos int, content string")
    text = LG.logs_prompt_content(keys, nested, github=gh).first().logs_content
    assert text.index("FILE: health.txt") < text.index("FILE: config.txt")     # fixed key-file order
    assert "\nGITHUB REFERENCE:\nsee https://github.com/o/r" in text
    assert text.endswith("COMPREHENSIVE FILE ANALYSIS:\nLog File Analysis:\n- health.txt: 10 characters\n"
                         "  Contains error indicators\n- config.txt: 7 characters\n  Contains warning indicators\n\n"
                         "Additional Logs Analysis:\n- a.log: 4 characters")
