"""C1-C4."""

import datetime as dt


from claimtrail.operators import scope


def _scope(spark, version=1, egress="deny", repos=(("repo-a", "/r/a", ["semgrep"]),)):
    s = spark.createDataFrame([("e1", version, egress, "c", dt.date(2030, 1, 1))],
                              "engagement_id string, version int, egress string, customer string, expires_on date")
    r = spark.createDataFrame([("e1", i, rid, p, checks) for i, (rid, p, checks) in enumerate(repos)],
                              "engagement_id string, pos long, repository_id string, path string, "
                              "allowed_checks array<string>")
    return s, r


def test_validate_scope(spark):
    for kw, reason in [({}, None), ({"version": 2}, "scope version must be 1"),
                       ({"egress": "open"}, "egress must be deny, local-only, or allow"),
                       ({"repos": ()}, "scope must authorize at least one repository"),
                       ({"repos": (("a b", "/x", []),)}, "repository_id contains unsupported characters"),
                       ({"repos": (("a", "/x", []), ("a", "/y", []))}, "repository_id values must be unique")]:
        s, r = _scope(spark, **kw)
        assert scope.validate_scope(s, r).first().reason == reason


def test_authorize(spark):
    s, r = _scope(spark)
    req = spark.createDataFrame([
        (1, "e1", "repo-a", "/r/a", "semgrep"), (2, "e1", "repo-z", "/r/a", "semgrep"),
        (3, "e1", "repo-a", "/r/a", "osv"), (4, "e1", "repo-a", "/other", "semgrep"),
    ], "request_id long, engagement_id string, repository_id string, path string, check string")
    got = {x.request_id: x for x in scope.authorize(req, s, r, "2029-12-31").collect()}
    assert got[1].allowed and got[2].reason == "repository is outside pilot scope: repo-z"
    assert got[3].reason == "check is outside pilot scope: osv"
    assert got[4].reason == "repository path does not match the authorized checkout"
    late = scope.authorize(req, s, r, "2031-01-01").collect()
    assert all(x.reason == "pilot authorization has expired" for x in late)
    # the expiry day itself is still valid (strict comparison)
    assert scope.authorize(req, s, r, "2030-01-01").where("request_id = 1").first().allowed


def test_egress(spark):
    urls = ["http://localhost:11434/v1", "http://127.0.0.1/v1", "http://[::1]:8080/", "HTTP://LocalHost/x",
            "http://127.255.0.9", "https://example.com/v1", "ftp://localhost/", "localhost:80", "http://127.0.0.256/",
            "http://0:0:0:0:0:0:0:1/", "http://user:pw@127.0.0.1:9/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.allowed for r in scope.egress_allowed(df, "deny").collect()}
    assert got == {
        "http://localhost:11434/v1": True, "http://127.0.0.1/v1": True, "http://[::1]:8080/": True,
        "HTTP://LocalHost/x": True, "http://127.255.0.9": True, "https://example.com/v1": False,
        "ftp://localhost/": False, "localhost:80": False, "http://127.0.0.256/": False,
        "http://0:0:0:0:0:0:0:1/": False, "http://user:pw@127.0.0.1:9/": True,
    }
    assert all(r.allowed for r in scope.egress_allowed(df, "allow").collect())


def test_check_coverage(spark):
    reqs = spark.createDataFrame([(1,), (2,), (3,)], "request_id long")
    checks = spark.createDataFrame([(1, "semgrep"), (1, "zap"), (1, "burp"), (2, "osv")], "request_id long, check string")
    got = {r.request_id: r for r in scope.check_coverage(reqs, checks).collect()}
    assert got[1].reason == "unsupported checks: burp, zap" and got[2].reason is None
    assert got[3].reason == "at least one check is required"
