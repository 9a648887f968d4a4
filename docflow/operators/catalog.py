"""Users, document rows and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Patterns and lists that decide what is accepted.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
USERNAME = r"^[a-zA-Z0-9_]{3,30}\z"
PASSWORD = r"^(?=.*[a-z])(?=.*[A-Z])(?=.*\d)(?=.*[@$!%*?&])[A-Za-z\d@$!%*?&]{8,}$"
MIME_TYPES = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/plain")
ROLES = ("user", "assistant")
MAX_UPLOADS = 10


def with_owner(documents: DataFrame, users: DataFrame, owner: str, user: str) -> DataFrame:
    """Documents with their owner's columns; documents without a known owner stay."""
    return documents.join(users, documents[owner] == users[user], "left")


def of_user(documents: DataFrame, users: DataFrame, owner: str, user: str, value: Column) -> DataFrame:
    """Documents whose owner's id is ``value``."""
    return documents.join(users, documents[owner] == users[user]).where(users[user] == value)


def owned(documents: DataFrame, document: str, owner: str, wanted: DataFrame) -> DataFrame:
    """Documents that match ``wanted`` (``id, user_id``) by id and owner."""
    return documents.join(wanted, (documents[document] == wanted["id"]) & (documents[owner] == wanted["user_id"]), "left_semi")


def unused(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """Candidates whose email and username no user has. Two anti joins on equality: an OR would not be one."""
    return candidates.join(users.select("email"), "email", "left_anti").join(users.select("username"), "username", "left_anti")


def accepted_upload(mime: Column) -> Column:
    return mime.isin(*MIME_TYPES)


def valid_email(email: Column) -> Column:
    return email.rlike(EMAIL) & (F.length(email) <= 50)


def valid_username(name: Column) -> Column:
    return name.rlike(USERNAME)


def valid_password(password: Column) -> Column:
    return F.length(password).between(8, 20) & password.rlike(PASSWORD)


def history(messages: DataFrame, role: str) -> DataFrame:
    """Messages of the roles that a chat shows."""
    return messages.where(F.col(role).isin(*ROLES))


def by_document(messages: DataFrame, document: str, order: str, role: str, content: str) -> DataFrame:
    """``document, messages``: each document's messages in order, ``array<struct<at, role, content>>``."""
    entry = F.struct(F.col(order).alias("at"), F.col(role).alias("role"), F.col(content).alias("content"))
    return messages.groupBy(document).agg(F.sort_array(F.collect_list(entry)).alias("messages"))


def uploaded_at(created: Column, uploaded: Column) -> Column:
    return F.coalesce(created, uploaded)


def without(documents: DataFrame, removed: DataFrame, document: str, owner: str) -> DataFrame:
    """Documents but those in ``removed`` (``id, user_id``) that belong to the user who asks."""
    return documents.join(removed, (documents[document] == removed["id"]) & (documents[owner] == removed["user_id"]), "left_anti")
