"""Schemas of the eleven ledger tables and of the landed JSON payloads."""

from __future__ import annotations

TABLES = {
    "TransferBlocks": "block_hash string, prev_block_id string, sender_did string, receiver_did string, txn_type string, amount double, epoch bigint, tokens string, validator_pledge_map string, txn_id string",
    "TokenType": "token_id string, token_type string, last_updated timestamp",
    "AllBlocks": "block_hash string, block_type string, epoch timestamp, txn_id string",
    "SmartContract": "contract_id string, block_hash string, deployer_did string, txn_id string, block_height bigint, token_status int",
    "RBT": "rbt_id string, owner_did string, block_id string, block_height string, token_value double, token_status int",
    "FT": "ft_id string, token_value double, ft_name string, owner_did string, creator_did string, block_height bigint, block_id string, txn_id string, token_status int",
    "NFT": "nft_id string, token_value string, owner_did string, block_hash string, txn_id string, block_height bigint, token_status int",
    "DIDs": "did string, created_at timestamp, total_rbts double, total_fts double, total_nfts bigint, total_sc bigint",
    "TxnAnalytics": "interval_start timestamp, interval_end timestamp, txn_count bigint, total_value double, token_type string",
    "SC_Blocks": "block_id string, contract_id string, executor_did string, block_height bigint, epoch timestamp, owner_did string",
    "BurntBlocks": "block_hash string, child_tokens string, txn_type string, owner_did string, epoch bigint, tokens string",
}

#: Their columns in order.
COLUMNS = {name: [column.split()[0] for column in text.split(", ")] for name, text in TABLES.items()}

ITEMS = {
    "RBT": "TokenID string, TokenValue double, OwnerDID string, PublisherDID string, TransactionID string, BlockHash string, BlockHeight bigint, SyncStaus int, TokenStatus int",
    "FT": "TokenID string, FTName string, OwnerDID string, CreatorDID string, PublisherDID string, TokenValue double, TransactionID string, BlockHash string, BlockHeight bigint, SyncStatus int, TokenStatus int",
    "NFT": "token_id string, token_value double, OwnerDID string, PublisherDID string, TransactionID string, BlockHash string, BlockHeight bigint, SyncStatus int, TokenStatus int",
    "SC": "smart_contract_hash string, deployer string, PublisherDID string, TransactionID string, BlockHash string, BlockHeight bigint, SyncStatus int, TokenStatus int",
}


_LINK = "`1` string, `4` string, `5` string, TTTokenTypeKey string, TTBlockNumberKey string, TTPreviousBlockIDKey string"
#: Fields of a block and of its transaction by their numeric and named keys; every scalar is read as text.
BLOCK_FIELDS = {"type_code": ("2", "TCTransTypeKey"), "owner_did": ("3", "TCTokenOwnerKey"), "pledges": ("8", "TCPledgeDetailsKey"), "amount_text": ("10", "TCTokenValueKey"), "children": ("11", "TCChildTokensKey"), "block_hash": ("98", "TCBlockHashKey"), "epoch_text": ("epoch", "TCEpoch")}
INFO_FIELDS = {"sender_did": ("1", "TISenderDIDKey"), "receiver_did": ("2", "TIReceiverDIDKey"), "comment": ("3", "TICommentKey"), "txn_id": ("4", "TITIDKey"), "deployer_did": ("8", "TIDeployerDIDKey"), "executor_did": ("9", "TIExecutorDIDKey")}


def block(*only: str) -> str:
    """The schema of a block with its known fields under numeric or named keys, or with those of `only` (names that operators.blocks.decode gives them)."""
    wanted = lambda name: not only or name in only
    texts = lambda fields: [f"`{k}` string" for name, keys in fields.items() if wanted(name) for k in keys]
    links = [f"`{k}` map<string, struct<{_LINK}>>" for k in ("6", "TITokensKey") if wanted("tokens")]
    info = texts(INFO_FIELDS) + links + ["TTPreviousBlockIDKey string"] * wanted("prev_block_id")
    return ", ".join(texts(BLOCK_FIELDS) + [f"`{k}` struct<{', '.join(info)}>" for k in ("5", "TCTransInfoKey") if info])


BLOCK = block()

CHANGE = "`table` string, data string, operation string, seq bigint"
CHANGE_DATA = "token_id string, TokenID string, smart_contract_hash string, OwnerDID string, deployer string, token_value double, TokenValue double, TokenStatus int"
AMOUNT = "status boolean, message string, result struct<TransactionID: string, TransactionValue: double, BlockHash: string>"
