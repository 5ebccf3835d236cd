"""Messages of peers and clients: CBOR arrays whose first element is the kind, as rows and back.

A message is read into its kind, the kind's name, the message id of peers' messages, and the other elements as JSON, in which bytes
stand as {"hex": ...}. The JSON says all that the bytes say, so writing a message that was read gives the same value again.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tessera.functions import cbor

#: Kinds of messages between peers, and between a client and its node.
PEER = {
    1: "ping", 2: "ping_response", 3: "ping_capacity", 4: "ping_capacity_response", 5: "ping_block", 6: "ping_block_response",
    7: "find_block", 8: "find_block_response", 9: "find_node", 10: "find_node_response", 11: "store_block", 12: "store_block_response",
    13: "seeking_blocks", 14: "seeking_blocks_response", 15: "rank_block", 16: "recall_block", 17: "recall_accept", 18: "recall_decline",
    19: "rate_limited", 20: "salutation", 21: "gossip", 22: "gossip_pull", 23: "closest_nodes", 24: "closest_nodes_response",
    25: "measure_nodes", 26: "measure_nodes_response", 27: "closest_nodes_progress", 30: "relay_send", 31: "relay_received",
    32: "addr_request", 33: "addr_response", 34: "relay_challenge", 35: "relay_challenge_response", 36: "relay_punch",
}
CLIENT = {
    1: "put_request", 2: "put_data", 3: "put_end", 4: "put_response", 5: "get_request", 6: "get_response_start", 7: "get_data", 8: "get_end",
    11: "error", 12: "auth_request", 13: "block_put_request", 14: "block_put_response", 15: "block_get_request", 16: "block_get_response",
    17: "block_delete_request", 18: "block_delete_response", 19: "health_request", 20: "health_response", 21: "peer_info_request",
    22: "peer_info_response", 23: "peer_connect", 24: "peer_connect_result", 25: "peer_list_request", 26: "peer_list_response",
    27: "friend_add", 28: "friend_remove", 29: "friend_list", 30: "friend_list_response", 31: "update_status_request",
    32: "update_status_response", 33: "config_show_request", 34: "config_show_response", 35: "config_set_request", 36: "config_set_response",
    37: "config_reload_request", 38: "config_reload_response",
}
#: Kinds of peers' messages that carry the two halves of a message id behind their kind.
IDENTIFIED = {7}
MESSAGE = StructType([StructField("kind", IntegerType()), StructField("name", StringType()), StructField("message_id", LongType()), StructField("fields", StringType())])


def _plain(value: Any) -> Any:
    if isinstance(value, bytes):
        return {"hex": value.hex()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {"map": [[_plain(k), _plain(v)] for k, v in value.items()]}
    return value


def _value(plain: Any) -> Any:
    if isinstance(plain, list):
        return [_value(v) for v in plain]
    if isinstance(plain, dict):
        return bytes.fromhex(plain["hex"]) if "hex" in plain else {_value(k): _value(v) for k, v in plain["map"]}
    return plain


def read(data: bytes, kinds: dict[int, str]) -> tuple[int, str | None, int | None, str] | None:
    """(kind, name, message id, other elements as JSON); None where data is no CBOR array that begins with a kind."""
    try:
        value = cbor.loads(data)
    except ValueError:
        return None
    if not isinstance(value, list) or not value or isinstance(value[0], bool) or not isinstance(value[0], int):
        return None
    kind, rest, message = value[0], value[1:], None
    if kinds == PEER and kind in IDENTIFIED and len(rest) >= 2:
        message = (rest[0] << 32 | rest[1]) & 0xFFFFFFFFFFFFFFFF
        message, rest = message - (1 << 64) if message >> 63 else message, rest[2:]
    return kind, kinds.get(kind), message, json.dumps(_plain(rest))


def write(kind: int, message: int | None, fields: str) -> bytes:
    halves = [] if message is None else [message >> 32 & 0xFFFFFFFF, message & 0xFFFFFFFF]
    return cbor.dumps([int(kind), *halves, *_value(json.loads(fields))])


def messages(data: Column, kinds: dict[int, str]) -> Column:
    """Struct MESSAGE of each byte string, null where it is none. kinds: PEER or CLIENT."""
    peers = kinds == PEER

    @F.pandas_udf(MESSAGE)
    def made(column: pd.Series) -> pd.DataFrame:
        found = [None if d is None else read(bytes(d), PEER if peers else CLIENT) for d in column]
        return pd.DataFrame({f.name: pd.Series([None if x is None else x[i] for x in found], dtype="Int64" if i in (0, 2) else object) for i, f in enumerate(MESSAGE.fields)})

    got = made(data)
    return F.when(got["kind"].isNotNull(), got)


@F.pandas_udf(BinaryType())
def written_messages(kind: pd.Series, message: pd.Series, fields: pd.Series) -> pd.Series:
    """The byte strings of messages (kind, message id or null, JSON)."""
    return pd.Series([None if pd.isna(k) or f is None else write(int(k), None if pd.isna(m) else int(m), f) for k, m, f in zip(kind, message, fields, strict=True)])
