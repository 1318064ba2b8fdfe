"""Names behind numeric block keys, transaction codes and labels."""

from __future__ import annotations

# Names of the keys of a block, by path.
BLOCK_KEYS = {
    "1": "TCTokenTypeKey",
    "2": "TCTransTypeKey",
    "3": "TCTokenOwnerKey",
    "4": "TCGenesisBlockKey",
    "5": "TCTransInfoKey",
    "6": "TCSmartContractKey",
    "7": "TCQuorumSignatureKey",
    "8": "TCPledgeDetailsKey",
    "9": "TCSmartContractDataKey",
    "10": "TCTokenValueKey",
    "11": "TCChildTokensKey",
    "12": "TCSenderSignatureKey",
    "98": "TCBlockHashKey",
    "99": "TCSignatureKey",
    "epoch": "TCEpoch",
    "4-1": "GBTypeKey",
    "4-2": "GBInfoKey",
    "4-2-1": "GITokenLevelKey",
    "4-2-2": "GITokenNumberKey",
    "4-2-3": "GIMigratedBlkIDKey",
    "4-2-4": "GIPreviousIDKey",
    "4-2-5": "GIParentIDKey",
    "4-2-6": "GIGrandParentIDKey",
    "4-2-7": "GICommitedTokensKey",
    "4-2-8": "GISmartContractValueKey",
    "5-1": "TISenderDIDKey",
    "5-2": "TIReceiverDIDKey",
    "5-3": "TICommentKey",
    "5-4": "TITIDKey",
    "5-5": "TIBlockKey",
    "5-6": "TITokensKey",
    "5-7": "TIRefIDKey",
    "5-8": "TIDeployerDIDKey",
    "5-9": "TIExecutorDIDKey",
    "5-10": "TICommitedTokensKey",
    "5-6-1": "TTTokenTypeKey",
    "5-6-2": "TTPledgedTokenKey",
    "5-6-3": "TTPledgedDIDKey",
    "5-6-4": "TTBlockNumberKey",
    "5-6-5": "TTPreviousBlockIDKey",
    "5-6-6": "TTUnpledgedIDKey",
    "5-6-7": "TTCommitedDIDKey",
    "5-10-1": "TTTokenTypeKey",
    "5-10-4": "TTBlockNumberKey",
    "5-10-5": "TTPreviousBlockIDKey",
    "5-10-6": "TTUnpledgedIDKey",
    "5-10-7": "TTCommitedDIDKey",
}

# Transaction names by two-digit code.
TRANSACTION_NAMES = {
    "01": "Minted",
    "02": "Transfer",
    "03": "Migrated",
    "04": "Pledged",
    "05": "Generation",
    "06": "Unpledged",
    "07": "Committed",
    "08": "Burnt",
    "09": "Deployed",
    "10": "Executed",
    "11": "ContractCommitted",
    "12": "PinnedAsService",
    "13": "BurntForFT",
}

# Block type labels by code; some one-digit codes count, others don't.
BLOCK_TYPES = {"02": "transfer", "2": "transfer", "08": "burnt", "13": "burnt_for_ft", "09": "deploy", "9": "deploy", "10": "execute", "05": "mint", "5": "mint"}

# Numbers of block type labels.
BLOCK_NUMBERS = {"transfer": 1, "burnt": 2, "burnt_for_ft": 3, "deploy": 4, "execute": 5, "mint": 6}

# Labels of burns.
BURN_LABELS = {"13": "Burnt for FT", "08": "Burnt"}

# Asset kinds by the table that a change names.
CHANGE_TABLES = {"FullnodeRBTtable": "RBT", "FullnodeFTtable": "FT", "FullnodeNFTtable": "NFT", "FullnodeSCtable": "SC"}

TRANSFER_CODES, BURN_CODES, DEPLOY_CODES, EXECUTE_CODES = ["02", "2"], ["08", "13"], ["09", "9"], ["10"]
