"""The tools of one session: a search and a fetch as single-row flows, behind the dispatcher and the server.

``python -m quarryspark.plans.serve`` answers on standard input and output with live nodes,
pages and model, as the environment names them.
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable
from functools import partial

from pyspark.sql import SparkSession

from quarryspark.functions.failures import PipelineError
from quarryspark.plans.config import ModelConfig, PipelineConfig
from quarryspark.plans.model import ChatModel, Model
from quarryspark.plans.server import ToolServer
from quarryspark.plans.tools import FetchParams, SearchParams, dispatcher
from quarryspark.plans.web import Stage, run_fetch, run_search
from quarryspark.runtime import local_session


def tool_server(spark: SparkSession, ask: Stage, fetch: Stage, make_model: Callable[[], Model], config: PipelineConfig | None = None) -> ToolServer:
    """A server whose tools run ``run_search`` and ``run_fetch``, within ``pipeline_timeout_ms`` each."""
    config = config or PipelineConfig.load()
    seconds = config.pipeline_timeout_ms / 1000

    def text_of(row) -> str:
        if row.outcome == "failed":
            raise PipelineError(row.text)
        return row.text

    def search(p: SearchParams) -> str:
        asked = spark.createDataFrame([(0, p.query)], "query_id long, query string")
        return text_of(run_search(asked, ask, fetch, make_model, config=config, max_results=p.max_results, focus=p.focus, seconds=seconds).first())

    def page(p: FetchParams) -> str:
        asked = spark.createDataFrame([(p.url,)], "url string")
        return text_of(run_fetch(asked, fetch, make_model, config=config, focus=p.focus, seconds=seconds).first())

    return ToolServer(dispatcher(search, page))


def main() -> None:
    from quarryspark.sources.pages import fetcher
    from quarryspark.sources.search import ask_nodes

    logging.basicConfig(stream=sys.stderr, level=logging.INFO)
    model = ModelConfig.load()
    ChatModel.of(model)  # a missing key or address is reported at once
    spark = local_session()
    tool_server(spark, ask_nodes(), fetcher(), partial(ChatModel.of, model)).serve(sys.stdin, sys.stdout)


if __name__ == "__main__":
    main()
