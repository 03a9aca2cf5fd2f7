"""A small program of our own, with answers worked out by hand in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = {
    "shop/main.py": '''
from fastapi import FastAPI
from shop import orders
app = FastAPI()
app.include_router(orders.router, prefix="/orders")
''',
    "shop/orders.py": '''
import requests
from fastapi import APIRouter
from shop.service import OrderService, Notifier
router = APIRouter()
URL = "/stock/items/{item}"

@router.get("/{order_id}")
def read_order(order_id: int):
    service = OrderService(Notifier())
    return service.load(order_id)

@router.post("/")
def create_order(kind: str):
    service = OrderService(Notifier())
    if kind == "express":
        service.express()
    elif kind == "bulk":
        service.bulk()
    else:
        raise ValueError(kind)
    requests.get("/stock/items/7")
''',
    "shop/service.py": '''
import sqlite3
from typing import Protocol

class Channel(Protocol):
    def send(self, text: str) -> None: ...

class Notifier:
    def send(self, text: str) -> None:
        print(text)

class Silent:
    def send(self, text: str) -> None:
        log(text)

class Base:
    def load(self, key):
        return fetch(key)

class OrderService(Base):
    def __init__(self, channel: Channel):
        self.channel = channel

    def express(self):
        self.channel.send("express")
        fetch(1)

    def bulk(self):
        for k in range(3):
            pack(k)

def fetch(key):
    return sqlite3.connect("db").execute("select * from orders where id = ?", key)

def pack(k):
    try:
        return fetch(k)
    except KeyError:
        log(k)

def log(x):
    print(x)
''',
    "stock/api.py": '''
from fastapi import APIRouter
router = APIRouter()

@router.get("/stock/items/{item}")
def item(item: int):
    return lookup(item)

def lookup(item):
    match item:
        case 0:
            return zero()
        case _ if item > 9:
            return many()
    return None

def zero():
    return 0

def many():
    return zero()
''',
    "shop/broken.py": "def (:\n",
    "shop/empty.py": "",
}


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("sample", p, c) for p, c in SOURCES.items()], "repo string, path string, content string")
