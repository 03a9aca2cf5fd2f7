"""Run-time dispatch, callbacks, parallel work and url patterns of a second small program; the SQL states answers worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.operators import dispatch
from forkline.plans.analysis import Analysis

SOURCES = {
    "site/urls.py": '''
from django.urls import include, path, re_path
from site import views
from site.views import Basket, Plain
urlpatterns = [
    path("", views.home),
    path("basket/", Basket.as_view()),
    path("plain/", Plain.as_view()),
    path("shop/", include("site.shop_urls")),
]
urlpatterns += [re_path("^old/$", views.missing)]
''',
    "site/shop_urls.py": '''
from django.urls import include, path
from site.views import item
urlpatterns = [path("items/<int:k>/", item), path("deep/", include("site.deep_urls"))]
''',
    "site/deep_urls.py": '''
from django.urls import include, path
from site import views
urlpatterns = [path("home/", views.home), path("again/", include("site.shop_urls"))]
''',
    "site/views.py": '''
class Base:
    def get(self, request):
        return home(request)
class Basket(Base):
    def post(self, request):
        return 1
class Plain:
    def dispatch(self, request):
        return 2
def home(request):
    return 3
def item(request, k):
    return 4
''',
    "site/work.py": '''
import asyncio
from site.views import home, item
ACTIONS = {"home": home, "item": item, 3: unknown}

def choose(key):
    return ACTIONS[key](None)

def ask(key):
    return ACTIONS.get(key)(None)

def named(self, kind):
    getattr(self, f"on_{kind}")()
    getattr(self, kind)()
    getattr(self, "fixed")()
    globals()[kind]()

def pick(flag):
    value = (home(1)
             if flag else
             item(1, 2))
    plain = 1 if flag else 2
    return value

def apply(func, value):
    return func(value)

def given():
    apply(home, 1)
    sorted([], key=item)

async def both():
    await asyncio.gather(home(1), item(1, 2))
    home(2)
''',
}


def _analysis(spark: SparkSession) -> Analysis:
    return Analysis(spark.createDataFrame([("web", p, c) for p, c in SOURCES.items()], "repo string, path string, content string"))


def url_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analysis(spark)
    return dispatch.url_routes(a.facts, a.index).select("method", "route_path", "handler")


def table_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analysis(spark)
    return dispatch.table_arms(a.facts, a.index).select("owner", "idx", "label", F.coalesce("handler", F.lit("")).alias("handler"))


def run_time_forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forks of conditional expressions and of names worked out at run time, with their arms."""
    facts = _analysis(spark).facts
    arm = facts.where("kind = 'arm'").select("owner", "line", F.col("extra")[1].cast("int").alias("column"), F.col("ordinal").alias("idx"), F.col("name").alias("label"))
    fork = facts.where("kind = 'fork'").select("owner", "line", F.col("ordinal").alias("column"), F.col("name").alias("kind"), F.col("detail").alias("selector"))
    return fork.join(arm, ["owner", "line", "column"], "left").select("owner", "kind", "selector", F.coalesce("idx", F.lit(-1)).alias("idx"), F.coalesce("label", F.lit("")).alias("label"))


def callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analysis(spark)
    return dispatch.callbacks(a.facts, a.targets, a.index).select("caller", "target")


def parallel_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analysis(spark)
    return dispatch.parallel(a.calls, a.targets).select("caller", F.array_join("callees", ",").alias("callees"))


SQL = {
    "url_routes": """SELECT * FROM (VALUES ('any', '', 'site.views.home'), ('get', 'basket/', 'site.views.Base.get'), ('post', 'basket/', 'site.views.Basket.post'),
  ('any', 'plain/', 'site.views.Plain.dispatch'), ('any', 'shop/items/<int:k>/', 'site.views.item'), ('any', 'shop/deep/home/', 'site.views.home')) t(method, route_path, handler)""",
    "table_arms": """SELECT * FROM (VALUES ('site.work.choose', 0, 'home', 'site.views.home'), ('site.work.choose', 1, 'item', 'site.views.item'), ('site.work.choose', 2, '3', ''),
  ('site.work.ask', 0, 'home', 'site.views.home'), ('site.work.ask', 1, 'item', 'site.views.item'), ('site.work.ask', 2, '3', '')) t(owner, idx, label, handler)""",
    "run_time_forks": """SELECT * FROM (VALUES ('site.work.named', 'dynamic', 'f''on_{kind}''', 0, 'on_*'), ('site.work.named', 'dynamic', 'kind', -1, ''), ('site.work.named', 'dynamic', 'kind', -1, ''),
  ('site.work.pick', 'branch', 'flag', 0, 'flag'), ('site.work.pick', 'branch', 'flag', 1, 'else')) t(owner, kind, selector, idx, label)""",
    "callbacks": """SELECT * FROM (VALUES ('site.work.apply', 'site.views.home'), ('site.work.given', 'site.views.item'), ('site.deep_urls.<module>', 'site.views.home'),
  ('site.urls.<module>', 'site.views.home'), ('site.shop_urls.<module>', 'site.views.item')) t(caller, target)""",
    "parallel_lines": """SELECT 'site.work.both' AS caller, 'site.views.home,site.views.item' AS callees""",
}

QUERIES = {name: globals()[name] for name in SQL}
