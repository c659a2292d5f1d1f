"""Explicit schemas and the fixed wire values of the envelope model."""

from __future__ import annotations

# Message names and enum texts as they appear on the wire.
INITIATED = "processFlow.initiated"
EXECUTE = "task.execute"
TASK_EVENT = "task.event"
SIGNAL = "task.signal"
LIFECYCLE = "flow.lifecycle"
MESSAGE_NAMES = (INITIATED, EXECUTE, TASK_EVENT, SIGNAL, LIFECYCLE)

# Defaults: how a deployment names its own components in ``source``; routing and conformance take others.
SOURCE_INTAKE = "intake"
SOURCE_ENGINE = "engine"
SOURCE_RUNNER = "runner"

# More enum texts, and the type name of an asynchronous reply.
ASYNC_REPLY = "TaskFinalAsyncResponseSend"
MESSAGE_TYPES = ("EVENT", "COMMAND", "SIGNAL")
INTENTS = ("EXECUTE", "CANCEL", "RETRY")
STATUSES = ("INITIAL", "IN_PROGRESS", "WAITING", "COMPLETED", "FAILED", "CANCELLED")
MODES = ("SYNC", "ASYNC")
FLOW_STATES = ("initial", "inProgress", "completed", "failed", "cancelled")
SCHEMA_VERSION = "1.0"
DEFAULT = "DEFAULT"
UNKNOWN = "UNKNOWN"

_RELATED_ENTITY = "struct<id:string,href:string,name:string,role:string,`@type`:string,`@referredType`:string>"
_TASK_FLOW_REF = "struct<id:string,href:string,`@referredType`:string>"
_CHARACTERISTIC = (
    "struct<id:string,name:string,value:string,valueType:string,`@type`:string,`@baseType`:string,"
    "characteristicRelationship:array<string>>"
)
_PROCESS_FLOW = (
    "struct<id:string,href:string,`@type`:string,state:string,channel:array<string>,`@baseType`:string,"
    f"relatedParty:array<string>,relatedEntity:array<{_RELATED_ENTITY}>,taskFlow:array<{_TASK_FLOW_REF}>,"
    f"characteristic:array<{_CHARACTERISTIC}>,processFlowSpecification:string>"
)
_TASK_FLOW = (
    "struct<id:string,href:string,`@type`:string,`@baseType`:string,state:string,taskFlowSpecification:string,"
    "completionMethod:string,isMandatory:boolean,priority:int,channel:array<string>,relatedParty:array<string>,"
    f"relatedEntity:array<{_RELATED_ENTITY}>,characteristic:array<{_CHARACTERISTIC}>,"
    f"taskFlowRelationship:array<struct<relationshipType:string,taskFlow:{_TASK_FLOW_REF}>>>"
)
_RESULT = (
    "struct<name:string,code:string,id:string,type:string,taskResult:string,"
    f"taskFlowResponse:{_TASK_FLOW},additionalProps:map<string,string>,workOrderCode:string,"
    "taskStatusCode:string,statusChangeReason:string>"
)
_INPUTS = (
    f"struct<processFlow:{_PROCESS_FLOW},downstream:struct<id:string,href:string>,"
    "dependencyResults:map<string,string>,externalEventId:string,externalType:string,reportingSystem:string>"
)

CORRUPT = "_corrupt_record"

ENVELOPE_WIRE = (
    "eventId string, correlationId string, schemaVersion string, eventTime timestamp, messageType string,"
    "messageName string, source string, dagKey string, intent string, status string,"
    "batch struct<index:int,total:int>, action struct<actionName:string,actionCode:string,dcxActionCode:string>,"
    "task struct<id:string,href:string>,"
    "execution struct<mode:string,timeoutMs:bigint,startedAt:timestamp,finishedAt:timestamp,durationMs:bigint>,"
    "downstream struct<id:string,href:string>, awaitingSignal struct<downstreamTransactionId:string>,"
    f"inputs {_INPUTS}, result {_RESULT},"
    f"error struct<code:string,message:string,retryable:boolean,details:map<string,string>>, {CORRUPT} string"
)

NOTIFICATION_WIRE = (
    "`@type` string, `@baseType` string, id string, href string, state string, channel array<string>,"
    f"relatedParty array<string>, relatedEntity array<{_RELATED_ENTITY}>, characteristic array<{_CHARACTERISTIC}>,"
    "processFlowSpecification string, correlationId string, description string, domain string, eventId string,"
    "eventTime string, eventType string, priority string, timeOccurred string, title string,"
    "analyticCharacteristic array<string>, source string, `@schemaLocation` string,"
    "event struct<id:string,href:string,callerIdentifier:array<string>>,"
    "reportingSystem struct<id:string,href:string,name:string,`@baseType`:string,`@schemaLocation`:string,"
    f"`@type`:string,`@referredType`:string>, {CORRUPT} string"
)

# Only what batch closing reads out of a stored result; other fields are ignored.
RESULT_BODY = (
    "taskStatusCode string, statusChangeReason string,"
    f"taskFlowResponse struct<href:string,characteristic:array<struct<name:string,value:string>>>, {CORRUPT} string"
)

DAG_DOCUMENT = (
    "dagKey string, match struct<processFlowSpecification:string>,"
    "batches array<struct<index:int,actions:array<struct<actionName:string,executionMode:string,flowType:string,"
    "modemType:string,dependsOn:array<string>>>>>, load_pos long"
)

ACTION_CODES = (
    "action_code string, action_name string, enabled boolean, action_type string, description string,"
    "created_time_stamp string, load_pos long"
)
DCX_CODES = "parent string, dcx_action_code string, modem_type string, flow_type string, load_pos long"

PROCESS_FLOW = _PROCESS_FLOW
RELATED_ENTITY = _RELATED_ENTITY
TASK_FLOW_REF = _TASK_FLOW_REF
CHARACTERISTIC = _CHARACTERISTIC
