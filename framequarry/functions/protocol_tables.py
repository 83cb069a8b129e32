"""Fixed values of the diagnostic and transport protocols: names, units and scales, in the order of their codes."""

# J1939: PGN, name, label, and for each SPN (number, name, byte, bit, bits, resolution, offset, unit).
PGNS = (
    (61444, "Electronic Engine Controller 1", "EEC1", ((899, "Engine Torque Mode", 0, 0, 4, 1, 0, ""), (512, "Driver's Demand Engine Torque", 1, 0, 8, 1, -125, "%"), (513, "Actual Engine Torque", 2, 0, 8, 1, -125, "%"), (190, "Engine Speed", 3, 0, 16, 0.125, 0, "rpm"), (512, "Source Address of Controlling Device", 5, 0, 8, 1, 0, ""), (1675, "Engine Starter Mode", 6, 4, 4, 1, 0, ""), (2432, "Engine Demand Torque", 7, 0, 8, 1, -125, "%"))),
    (61443, "Electronic Engine Controller 2", "EEC2", ((91, "Accelerator Pedal Position 1", 0, 0, 8, 0.4, 0, "%"), (92, "Engine Percent Load At Current Speed", 1, 0, 8, 1, 0, "%"), (558, "Accelerator Pedal Position 2", 2, 0, 8, 0.4, 0, "%"), (2975, "Actual Max Available Torque", 3, 0, 8, 1, -125, "%"))),
    (65262, "Engine Temperature 1", "ET1", ((110, "Engine Coolant Temperature", 0, 0, 8, 1, -40, "degC"), (174, "Engine Fuel Temperature 1", 1, 0, 8, 1, -40, "degC"), (175, "Engine Oil Temperature 1", 2, 0, 8, 1, -40, "degC"), (176, "Engine Turbo Oil Temperature", 3, 0, 8, 1, -40, "degC"), (52, "Engine Intercooler Temperature", 4, 0, 8, 1, -40, "degC"))),
    (65265, "Cruise Control / Vehicle Speed", "CCVS", ((84, "Wheel Based Speed", 1, 0, 16, 1 / 256, 0, "km/h"), (595, "Cruise Control Active", 3, 0, 2, 1, 0, ""), (597, "Brake Switch", 3, 4, 2, 1, 0, ""), (598, "Clutch Switch", 3, 2, 2, 1, 0, ""), (976, "PTO State", 7, 0, 5, 1, 0, ""))),
    (65266, "Fuel Economy", "LFE", ((183, "Engine Fuel Rate", 0, 0, 16, 0.05, 0, "L/h"), (184, "Engine Instantaneous Fuel Economy", 2, 0, 16, 1 / 512, 0, "km/L"), (185, "Engine Average Fuel Economy", 4, 0, 16, 1 / 512, 0, "km/L"), (182, "Engine Trip Fuel", 6, 0, 16, 0.5, 0, "L"))),
    (65276, "Dash Display", "DD", ((168, "Battery Potential / Voltage", 0, 0, 16, 0.05, 0, "V"), (177, "Transmission Oil Temperature", 2, 0, 8, 1, -40, "degC"), (127, "Transmission Oil Level", 4, 0, 8, 0.4, 0, "%"))),
    (65270, "Inlet / Exhaust Conditions 1", "IC1", ((102, "Boost Pressure", 1, 0, 16, 2, 0, "kPa"), (106, "Air Inlet Pressure", 4, 0, 8, 2, 0, "kPa"), (105, "Intake Manifold Temperature", 0, 0, 8, 1, -40, "degC"))),
    (65267, "Vehicle Position", "VP", ((245, "Vehicle Total Distance", 0, 0, 32, 5, 0, "m"),)),
    (65226, "Active Diagnostic Trouble Codes", "DM1", ((1213, "Malfunction Indicator Lamp", 0, 6, 2, 1, 0, ""), (623, "Red Stop Lamp", 0, 4, 2, 1, 0, ""), (624, "Amber Warning Lamp", 0, 2, 2, 1, 0, ""), (987, "Protect Lamp", 0, 0, 2, 1, 0, ""))),
    (60416, "Transport Protocol – CM", "TP.CM", ()),
    (60160, "Transport Protocol – DT", "TP.DT", ()),
    (65254, "Time/Date", "TD", ((1601, "Seconds", 0, 0, 8, 0.25, 0, "s"), (1602, "Minutes", 1, 0, 8, 1, 0, "min"), (1603, "Hours", 2, 0, 8, 1, 0, "h"), (1604, "Day", 4, 0, 8, 1, 0, ""), (1605, "Month", 3, 0, 8, 1, 0, ""), (1606, "Year", 5, 0, 16, 1, 1985, ""))),
    (65271, "Vehicle Electrical Power 1", "VEP1", ((168, "Electrical Potential", 0, 0, 16, 0.05, 0, "V"), (167, "Alternator Potential", 2, 0, 16, 0.05, 0, "V"), (158, "Battery Current", 4, 0, 16, 0.05, -1600, "A"))),
    (65263, "Cab Message 1", "CM1", ((597, "Parking Brake Switch", 3, 0, 2, 1, 0, ""), (70, "Seat Belt Switch", 2, 2, 2, 1, 0, ""))),
)
SOURCES = {0x00: "Engine #1", 0x03: "Engine #2", 0x0B: "Brakes – Controller", 0x11: "Brakes – Trailer", 0x13: "Transmission #1", 0x17: "Transmission #2", 0x21: "Instrument Cluster", 0x23: "Body Controller", 0x2B: "Cab Controller", 0x33: "Suspension – Front", 0x40: "Turbo/Supercharger", 0x47: "On-Board Diagnostics (OBD)", 0x49: "Vehicle Dynamics", 0xF9: "Off-board tool", 0xFE: "Null address"}

# OBD: modes, and for each (mode, PID) name, unit, scale, offset and value bytes.
OBD_MODES = {0x01: "Current Data", 0x02: "Freeze Frame", 0x03: "Stored DTC", 0x04: "Clear DTC", 0x05: "Oxygen Sensor", 0x06: "On-Board Monitoring", 0x07: "Pending DTC", 0x08: "Control Operation", 0x09: "Vehicle Information", 0x0A: "Permanent DTC"}
OBD_PIDS = (
    (1, 0x00, "PIDs supported (00-20)", "", 1, 0, 4), (1, 0x04, "Calculated Engine Load", "%", 100 / 255, 0, 1), (1, 0x05, "Engine Coolant Temp", "°C", 1, -40, 1), (1, 0x0A, "Fuel Pressure", "kPa", 3, 0, 1),
    (1, 0x0B, "Intake Manifold Pressure", "kPa", 1, 0, 1), (1, 0x0C, "Engine RPM", "rpm", 0.25, 0, 2), (1, 0x0D, "Vehicle Speed", "km/h", 1, 0, 1), (1, 0x0E, "Timing Advance", "°", 0.5, -64, 1),
    (1, 0x0F, "Intake Air Temperature", "°C", 1, -40, 1), (1, 0x10, "MAF Air Flow Rate", "g/s", 0.01, 0, 2), (1, 0x11, "Throttle Position", "%", 100 / 255, 0, 1), (1, 0x13, "Oxygen Sensors Present", "", 1, 0, 1),
    (1, 0x14, "O2 Sensor 1 Voltage", "V", 0.005, 0, 1), (1, 0x1C, "OBD Standard", "", 1, 0, 1), (1, 0x1F, "Run Time Since Start", "s", 1, 0, 2), (1, 0x20, "PIDs supported (21-40)", "", 1, 0, 4),
    (1, 0x21, "Distance with MIL", "km", 1, 0, 2), (1, 0x22, "Fuel Rail Pressure (rel)", "kPa", 0.079, 0, 2), (1, 0x23, "Fuel Rail Pressure (abs)", "kPa", 10, 0, 2), (1, 0x2C, "Commanded EGR", "%", 100 / 255, 0, 1),
    (1, 0x2E, "Commanded Evap. Purge", "%", 100 / 255, 0, 1), (1, 0x2F, "Fuel Level Input", "%", 100 / 255, 0, 1), (1, 0x30, "Warm-ups Since Clear", "", 1, 0, 1), (1, 0x31, "Distance Since Clear", "km", 1, 0, 2),
    (1, 0x33, "Barometric Pressure", "kPa", 1, 0, 1), (1, 0x42, "Control Module Voltage", "V", 0.001, 0, 2), (1, 0x43, "Absolute Load Value", "%", 100 / 255, 0, 2), (1, 0x45, "Relative Throttle Pos", "%", 100 / 255, 0, 1),
    (1, 0x46, "Ambient Air Temperature", "°C", 1, -40, 1), (1, 0x47, "Abs. Throttle Position B", "%", 100 / 255, 0, 1), (1, 0x49, "Accel. Pedal Position D", "%", 100 / 255, 0, 1), (1, 0x4C, "Cmd. Throttle Actuator", "%", 100 / 255, 0, 1),
    (1, 0x4D, "Time MIL On", "min", 1, 0, 2), (1, 0x4E, "Time Since DTC Cleared", "min", 1, 0, 2), (1, 0x5C, "Engine Oil Temperature", "°C", 1, -40, 1), (1, 0x5E, "Engine Fuel Rate", "L/h", 0.05, 0, 2),
    (9, 0x02, "VIN (chars 1-4)", "", 1, 0, 1), (9, 0x04, "Calibration ID", "", 1, 0, 1), (9, 0x06, "CVN", "", 1, 0, 1),
)

# UDS: services, data identifiers, negative response codes, sub-functions.
UDS_SERVICES = {0x10: "Diagnostic Session Control", 0x11: "ECU Reset", 0x14: "Clear Diagnostic Information", 0x19: "Read DTC Information", 0x22: "Read Data By Identifier", 0x23: "Read Memory By Address", 0x27: "Security Access", 0x28: "Communication Control", 0x2A: "Read Data By Periodic ID", 0x2C: "Dynamically Define DID", 0x2E: "Write Data By Identifier", 0x2F: "InputOutput Control By ID", 0x31: "Routine Control", 0x34: "Request Download", 0x35: "Request Upload", 0x36: "Transfer Data", 0x37: "Request Transfer Exit", 0x38: "Request File Transfer", 0x3D: "Write Memory By Address", 0x3E: "Tester Present", 0x84: "Secured Data Transmission"}
UDS_DIDS = {0xF180: "Boot Software Identification", 0xF181: "Application Software Identification", 0xF186: "Active Diagnostic Session", 0xF187: "Vehicle Manufacturer Spare Part Number", 0xF190: "VIN", 0xF191: "Vehicle Manufacturer ECU Hardware Number", 0xF192: "System Supplier Identifier", 0xF194: "System Name or Engine Type", 0xF195: "Repair Shop Code", 0xF197: "Programming Date", 0xF1A0: "ECU Serial Number", 0xF1A5: "ECU Manufacturing Date", 0xF1A6: "Vehicle Speed (km/h)", 0xF1A8: "Engine Speed (rpm)", 0xF1B1: "Engine Coolant Temperature", 0xF1B2: "Battery Voltage", 0xF1B3: "Fuel Level", 0xF1B4: "Engine Oil Pressure", 0xF1B5: "Intake Air Temperature", 0xF1C0: "Odometer Value", 0xF1C1: "Total Engine Run Time", 0xF1C2: "Number of Warm-ups", 0xF1C5: "Ambient Air Temperature", 0xF1D0: "Calibration Identification", 0xF1D1: "Calibration Verification Number"}
UDS_NRCS = {0x10: "General Reject", 0x11: "Service Not Supported", 0x12: "Sub-Function Not Supported", 0x13: "Incorrect Message Length", 0x14: "Response Too Long", 0x21: "Busy – Repeat Request", 0x22: "Conditions Not Correct", 0x24: "Request Sequence Error", 0x25: "No Response From Subnet", 0x26: "Failure Prevents Execution", 0x31: "Request Out Of Range", 0x33: "Security Access Denied", 0x35: "Invalid Key", 0x36: "Exceeded Number Of Attempts", 0x37: "Required Time Delay Not Expired", 0x70: "Upload/Download Not Accepted", 0x71: "Transfer Data Suspended", 0x72: "General Programming Failure", 0x73: "Wrong Block Sequence Counter", 0x78: "Request Correctly Received – Response Pending", 0x7E: "Sub-Function Not Supported In Active Session", 0x7F: "Service Not Supported In Active Session"}
UDS_SUBS = {(0x10, 1): "Default Session", (0x10, 2): "Programming Session", (0x10, 3): "Extended Diagnostic Session", (0x10, 4): "Safety System Session", (0x11, 1): "Hard Reset", (0x11, 2): "Key Off/On Reset", (0x11, 3): "Soft Reset", (0x11, 4): "Enable Rapid Power Shutdown", (0x11, 5): "Disable Rapid Power Shutdown", (0x28, 0): "Enable Rx and Tx", (0x28, 1): "Enable Rx, Disable Tx", (0x28, 2): "Disable Rx, Enable Tx", (0x28, 3): "Disable Rx and Tx"}

# CANopen: least and greatest identifier of each message type, commands and states.
CANOPEN_TYPES = ((0x000, 0x000, "NMT"), (0x080, 0x080, "SYNC"), (0x081, 0x0FF, "EMCY"), (0x181, 0x1FF, "PDO1 TX"), (0x201, 0x27F, "PDO1 RX"), (0x281, 0x2FF, "PDO2 TX"), (0x301, 0x37F, "PDO2 RX"), (0x381, 0x3FF, "PDO3 TX"), (0x401, 0x47F, "PDO3 RX"), (0x481, 0x4FF, "PDO4 TX"), (0x501, 0x57F, "PDO4 RX"), (0x581, 0x5FF, "SDO TX"), (0x601, 0x67F, "SDO RX"), (0x701, 0x77F, "Heartbeat"))
NMT_COMMANDS = {0x01: "Start Remote Node", 0x02: "Stop Remote Node", 0x80: "Enter Pre-Operational", 0x81: "Reset Node", 0x82: "Reset Communication"}
EMCY_CODES = {0x1000: "Generic Error", 0x5000: "Device Hardware", 0x6000: "Device Software", 0x8100: "Communication", 0x8210: "PDO Length Exceeded"}
SDO_COMMANDS = {0: "Download Segment", 1: "Initiate Download", 2: "Upload Segment", 3: "Initiate Upload", 4: "Abort Transfer"}
HEARTBEAT_STATES = {0x00: "Boot-up", 0x04: "Stopped", 0x05: "Operational", 0x7F: "Pre-operational"}

LIN_NAMES = {0x3C: "MasterReq (Diagnostics)", 0x3D: "SlaveResp (Diagnostics)", 0x3E: "Reserved (SAE)", 0x3F: "Reserved (SAE)"}

XCP_COMMANDS = {0xFF: "CONNECT / POSITIVE_RESPONSE", 0xFE: "DISCONNECT / NEGATIVE_RESPONSE", 0xFD: "GET_STATUS / EV (Event)", 0xFC: "SYNCH / SERV (Service)", 0xFB: "GET_COMM_MODE_INFO", 0xFA: "GET_ID", 0xF6: "SET_MTA", 0xF5: "UPLOAD", 0xF4: "SHORT_UPLOAD", 0xF3: "BUILD_CHECKSUM", 0xF0: "DOWNLOAD", 0xED: "SHORT_DOWNLOAD", 0xE3: "CLEAR_DAQ_LIST", 0xE2: "SET_DAQ_PTR", 0xE1: "WRITE_DAQ", 0xE0: "SET_DAQ_LIST_MODE", 0xDE: "START_STOP_DAQ_LIST", 0xDD: "START_STOP_SYNCH", 0xDC: "GET_DAQ_CLOCK", 0xDB: "READ_DAQ", 0xDA: "GET_DAQ_LIST_STATUS", 0xD9: "GET_DAQ_LIST_INFO", 0xD2: "PROGRAM_START", 0xD1: "PROGRAM_CLEAR", 0xD0: "PROGRAM", 0xC6: "TIME_CORRELATION", 0xC0: "TRANSPORT_LAYER"}
XCP_ERRORS = {0x00: "Command processor synchronisation", 0x10: "Command was not executed (busy)", 0x11: "Command rejected because DAQ is running", 0x12: "Command rejected because PGM is running", 0x20: "Unknown command or not implemented", 0x21: "Command syntax invalid", 0x22: "Command syntax valid but parameter(s) out of range", 0x23: "The memory location is write protected", 0x24: "The memory location is not accessible", 0x25: "Access denied (seed & key required)", 0x26: "Selected page is not available", 0x27: "Selected page mode is not available", 0x28: "Selected segment is not valid", 0x29: "Sequence error", 0x2A: "DAQ configuration is not valid", 0x30: "Memory overflow error", 0x31: "Generic error", 0x32: "The slave internal program verify routine detects an error"}

KWP_SERVICES = {0x10: "StartDiagnosticSession", 0x11: "ECUReset", 0x12: "ReadFreezeFrameData", 0x14: "ClearDiagnosticInformation", 0x18: "ReadDTCByStatus", 0x1A: "ReadEcuIdentification", 0x20: "StopDiagnosticSession", 0x21: "ReadDataByLocalIdentifier", 0x22: "ReadDataByIdentifier", 0x27: "SecurityAccess", 0x30: "InputOutputControlByLocalId", 0x31: "StartRoutineByLocalId", 0x32: "StopRoutineByLocalId", 0x33: "RequestRoutineResultsByLocalId", 0x3B: "WriteDataByLocalIdentifier", 0x3E: "TesterPresent", 0x7F: "NegativeResponse"}
KWP_NRCS = {0x10: "General reject", 0x11: "Service not supported", 0x12: "Sub-function not supported", 0x21: "Busy, repeat request", 0x22: "Conditions not correct", 0x24: "Request sequence error", 0x31: "Request out of range", 0x33: "Security access denied", 0x35: "Invalid key", 0x36: "Exceeded number of attempts", 0x70: "Upload/download not accepted", 0x71: "Transfer data suspended", 0x78: "Response pending", 0x80: "Service not supported in active session"}

DOIP_TYPES = {0x0000: "Generic NACK", 0x0001: "Vehicle Ident Request", 0x0002: "Vehicle Ident Request (VIN)", 0x0003: "Vehicle Ident Request (EID)", 0x0004: "Vehicle Announcement / Ident Response", 0x0005: "Routing Activation Request", 0x0006: "Routing Activation Response", 0x0007: "Alive Check Request", 0x0008: "Alive Check Response", 0x4001: "DoIP Entity Status Request", 0x4002: "DoIP Entity Status Response", 0x4003: "Diag Power Mode Info Request", 0x4004: "Diag Power Mode Info Response", 0x8001: "Diagnostic Message (UDS)", 0x8002: "Diagnostic Message ACK", 0x8003: "Diagnostic Message NACK"}
DOIP_NACKS = {0x00: "Incorrect pattern format", 0x01: "Unknown payload type", 0x02: "Message too large", 0x03: "Out of memory", 0x04: "Invalid payload length"}
DOIP_ROUTING = {0x00: "Denied: unknown source address", 0x01: "Denied: all sockets active", 0x02: "Denied: SA already active (socket)", 0x03: "Denied: SA already active (entity)", 0x04: "Denied: authentication required", 0x05: "Denied: confirmation required", 0x06: "Denied: unsupported activation type", 0x10: "Success: confirmation required", 0x11: "Success"}
DOIP_ACKS = {0x00: "ACK", 0x02: "NACK: invalid source address", 0x03: "NACK: unknown target address", 0x04: "NACK: diagnostic message too large", 0x05: "NACK: out of memory", 0x06: "NACK: target unreachable", 0x07: "NACK: unknown network", 0x08: "NACK: transport protocol error"}

SOMEIP_TYPES = {0x00: "REQUEST", 0x01: "REQUEST_NO_RETURN", 0x02: "NOTIFICATION", 0x40: "REQUEST_ACK", 0x80: "RESPONSE", 0x81: "ERROR"}
SOMEIP_CODES = {0x00: "E_OK", 0x01: "E_NOT_OK", 0x02: "E_UNKNOWN_SERVICE", 0x03: "E_UNKNOWN_METHOD", 0x04: "E_NOT_READY", 0x05: "E_NOT_REACHABLE", 0x06: "E_TIMEOUT", 0x07: "E_WRONG_PROTOCOL_VERSION", 0x08: "E_WRONG_INTERFACE_VERSION", 0x09: "E_MALFORMED_MESSAGE", 0x0A: "E_WRONG_MESSAGE_TYPE"}
SOMEIP_ENTRIES = {0x00: "FindService", 0x01: "OfferService", 0x06: "SubscribeEventgroup", 0x07: "SubscribeEventgroupAck"}
