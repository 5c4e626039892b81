"""Token streams: decoding and the encoder of test streams."""

from __future__ import annotations

import struct

import numpy as np

TRUNCATED, BAD_STRING = "Truncated", "BadString"

#: Keywords by id (0 is empty), macros, operators from opcode 0x40 on.
KEYWORDS = ("", "And", "Or", "Not", "If", "Then", "Else", "ElseIf", "EndIf", "While", "WEnd", "Do", "Until", "For", "Next", "To", "Step", "In", "ExitLoop", "ContinueLoop", "Select", "Case", "EndSelect", "Switch", "EndSwitch", "ContinueCase", "Dim", "ReDim", "Local", "Global", "Const", "Static", "Func", "EndFunc", "Return", "Exit", "ByRef", "With", "EndWith", "True", "False", "Default", "Null", "Volatile", "Enum")
#: Function names by id, from 0 on.
FUNCTIONS = (
    "Abs", "ACos", "AdlibRegister", "AdlibUnRegister", "Asc", "AscW", "ASin", "Assign", "ATan", "AutoItSetOption", "AutoItWinGetTitle",
    "AutoItWinSetTitle", "Beep", "Binary", "BinaryLen", "BinaryMid", "BinaryToString", "BitAND", "BitNOT", "BitOR", "BitRotate", "BitShift", "BitXOR",
    "BlockInput", "Break", "Call", "CDTray", "Ceiling", "Chr", "ChrW", "ClipGet", "ClipPut", "ConsoleRead", "ConsoleWrite", "ConsoleWriteError",
    "ControlClick", "ControlCommand", "ControlDisable", "ControlEnable", "ControlFocus", "ControlGetFocus", "ControlGetHandle", "ControlGetPos",
    "ControlGetText", "ControlHide", "ControlListView", "ControlMove", "ControlSend", "ControlSetText", "ControlShow", "ControlTreeView", "Cos",
    "Dec", "DirCopy", "DirCreate", "DirGetSize", "DirMove", "DllCall", "DllCallAddress", "DllCallbackFree", "DllCallbackGetPtr",
    "DllCallbackRegister", "DllClose", "DllOpen", "DllStructCreate", "DllStructGetData", "DllStructGetPtr", "DllStructGetSize", "DllStructSetData",
    "DriveGetDrive", "DriveGetFileSystem", "DriveGetLabel", "DriveGetSerial", "DriveGetType", "DriveMapAdd", "DriveMapDel", "DriveMapGet",
    "DriveSetLabel", "DriveSpaceFree", "DriveSpaceTotal", "DriveStatus", "DummySpeedTest", "EnvGet", "EnvSet", "EnvUpdate", "Eval", "Execute", "Exp",
    "FileChangeDir", "FileClose", "FileCopy", "FileCreateNTFSLink", "FileCreateShortcut", "FileDelete", "FileExists", "FileFindFirstFile",
    "FileFindNextFile", "FileFlush", "FileGetAttrib", "FileGetEncoding", "FileGetLongName", "FileGetPos", "FileGetShortcut", "FileGetShortName",
    "FileGetSize", "FileGetTime", "FileGetVersion", "FileInstall", "FileMove", "FileOpen", "FileOpenDialog", "FileRead", "FileReadLine",
    "FileReadToArray", "FileRecycle", "FileRecycleEmpty", "FileSaveDialog", "FileSelectFolder", "FileSetAttrib", "FileSetEnd", "FileSetPos",
    "FileSetTime", "FileWrite", "FileWriteLine", "Floor", "FtpSetProxy", "FuncName", "GUICreate", "GUICtrlCreateAvi", "GUICtrlCreateButton",
    "GUICtrlCreateCheckbox", "GUICtrlCreateCombo", "GUICtrlCreateContextMenu", "GUICtrlCreateDate", "GUICtrlCreateDummy", "GUICtrlCreateEdit",
    "GUICtrlCreateGraphic", "GUICtrlCreateGroup", "GUICtrlCreateIcon", "GUICtrlCreateInput", "GUICtrlCreateLabel", "GUICtrlCreateList",
    "GUICtrlCreateListView", "GUICtrlCreateListViewItem", "GUICtrlCreateMenu", "GUICtrlCreateMenuItem", "GUICtrlCreateMonthCal", "GUICtrlCreateObj",
    "GUICtrlCreatePic", "GUICtrlCreateProgress", "GUICtrlCreateRadio", "GUICtrlCreateSlider", "GUICtrlCreateTab", "GUICtrlCreateTabItem",
    "GUICtrlCreateTreeView", "GUICtrlCreateTreeViewItem", "GUICtrlCreateUpdown", "GUICtrlDelete", "GUICtrlGetHandle", "GUICtrlGetState",
    "GUICtrlRead", "GUICtrlRecvMsg", "GUICtrlRegisterListViewSort", "GUICtrlSendMsg", "GUICtrlSendToDummy", "GUICtrlSetBkColor", "GUICtrlSetColor",
    "GUICtrlSetCursor", "GUICtrlSetData", "GUICtrlSetDefBkColor", "GUICtrlSetDefColor", "GUICtrlSetFont", "GUICtrlSetGraphic", "GUICtrlSetImage",
    "GUICtrlSetLimit", "GUICtrlSetOnEvent", "GUICtrlSetPos", "GUICtrlSetResizing", "GUICtrlSetState", "GUICtrlSetStyle", "GUICtrlSetTip", "GUIDelete",
    "GUIGetCursorInfo", "GUIGetMsg", "GUIGetStyle", "GUIRegisterMsg", "GUISetAccelerators", "GUISetBkColor", "GUISetCoord", "GUISetCursor",
    "GUISetFont", "GUISetHelp", "GUISetIcon", "GUISetOnEvent", "GUISetState", "GUISetStyle", "GUIStartGroup", "GUISwitch", "Hex", "HotKeySet",
    "HttpSetProxy", "HttpSetUserAgent", "HWnd", "InetClose", "InetGet", "InetGetInfo", "InetGetSize", "InetRead", "IniDelete", "IniRead",
    "IniReadSection", "IniReadSectionNames", "IniRenameSection", "IniWrite", "IniWriteSection", "InputBox", "Int", "IsAdmin", "IsArray", "IsBinary",
    "IsBool", "IsDeclared", "IsDllStruct", "IsFloat", "IsFunc", "IsHWnd", "IsInt", "IsKeyword", "IsMap", "IsNumber", "IsObj", "IsPtr", "IsString",
    "Log", "MapAppend", "MapExists", "MapKeys", "MapRemove", "MemGetStats", "Mod", "MouseClick", "MouseClickDrag", "MouseDown", "MouseGetCursor",
    "MouseGetPos", "MouseMove", "MouseUp", "MouseWheel", "MsgBox", "Number", "ObjCreate", "ObjCreateInterface", "ObjEvent", "ObjGet", "ObjName",
    "OnAutoItExitRegister", "OnAutoItExitUnRegister", "Opt", "Ping", "PixelChecksum", "PixelGetColor", "PixelSearch", "ProcessClose", "ProcessExists",
    "ProcessGetStats", "ProcessList", "ProcessSetPriority", "ProcessWait", "ProcessWaitClose", "ProgressOff", "ProgressOn", "ProgressSet", "Ptr",
    "Random", "RegDelete", "RegEnumKey", "RegEnumVal", "RegRead", "RegWrite", "Round", "Run", "RunAs", "RunAsWait", "RunWait", "Send",
    "SendKeepActive", "SetError", "SetExtended", "ShellExecute", "ShellExecuteWait", "Shutdown", "Sin", "Sleep", "SoundPlay", "SoundSetWaveVolume",
    "SplashImageOn", "SplashOff", "SplashTextOn", "Sqrt", "SRandom", "StatusbarGetText", "StdErrRead", "StdInWrite", "StdioClose", "StdOutRead",
    "String", "StringAddCR", "StringCompare", "StringFormat", "StringFromASCIIArray", "StringInStr", "StringIsAlNum", "StringIsAlpha",
    "StringIsASCII", "StringIsDigit", "StringIsFloat", "StringIsInt", "StringIsLower", "StringIsSpace", "StringIsUpper", "StringIsXDigit",
    "StringLeft", "StringLen", "StringLower", "StringMid", "StringRegExp", "StringRegExpReplace", "StringReplace", "StringReverse", "StringRight",
    "StringSplit", "StringStripCR", "StringStripWS", "StringToASCIIArray", "StringToBinary", "StringTrimLeft", "StringTrimRight", "StringUpper",
    "Tan", "TCPAccept", "TCPCloseSocket", "TCPConnect", "TCPListen", "TCPNameToIP", "TCPRecv", "TCPSend", "TCPShutdown", "TCPStartup", "TimerDiff",
    "TimerInit", "ToolTip", "TrayCreateItem", "TrayCreateMenu", "TrayGetMsg", "TrayItemDelete", "TrayItemGetHandle", "TrayItemGetState",
    "TrayItemGetText", "TrayItemSetOnEvent", "TrayItemSetState", "TrayItemSetText", "TraySetClick", "TraySetIcon", "TraySetOnEvent",
    "TraySetPauseIcon", "TraySetState", "TraySetToolTip", "TrayTip", "UBound", "UDPBind", "UDPCloseSocket", "UDPOpen", "UDPRecv", "UDPSend",
    "UDPShutdown", "UDPStartup", "VarGetType", "WinActivate", "WinActive", "WinClose", "WinExists", "WinFlash", "WinGetCaretPos", "WinGetClassList",
    "WinGetClientSize", "WinGetHandle", "WinGetPos", "WinGetProcess", "WinGetState", "WinGetText", "WinGetTitle", "WinKill", "WinList",
    "WinMenuSelectItem", "WinMinimizeAll", "WinMinimizeAllUndo", "WinMove", "WinSetOnTop", "WinSetState", "WinSetTitle", "WinSetTrans", "WinWait",
    "WinWaitActive", "WinWaitClose", "WinWaitNotActive",
)
MACROS = (
    "AppDataCommonDir", "AppDataDir", "AutoItExe", "AutoItPID", "AutoItVersion", "AutoItX64", "COM_EventObj", "CommonFilesDir", "Compiled",
    "ComputerName", "ComSpec", "CPUArch", "CR", "CRLF", "DesktopCommonDir", "DesktopDepth", "DesktopDir", "DesktopHeight", "DesktopRefresh",
    "DesktopWidth", "DocumentsCommonDir", "error", "exitCode", "exitMethod", "extended", "FavoritesCommonDir", "FavoritesDir", "GUI_CtrlHandle",
    "GUI_CtrlId", "GUI_DragFile", "GUI_DragId", "GUI_DropId", "GUI_WinHandle", "HomeDrive", "HomePath", "HomeShare", "HotKeyPressed", "HOUR",
    "IPAddress1", "IPAddress2", "IPAddress3", "IPAddress4", "KBLayout", "LF", "LocalAppDataDir", "LogonDNSDomain", "LogonDomain", "LogonServer",
    "MDAY", "MIN", "MON", "MSEC", "MUILang", "MyDocumentsDir", "NumParams", "OSArch", "OSBuild", "OSLang", "OSServicePack", "OSType", "OSVersion",
    "ProgramFilesDir", "ProgramsCommonDir", "ProgramsDir", "ScriptDir", "ScriptFullPath", "ScriptLineNumber", "ScriptName", "SEC",
    "StartMenuCommonDir", "StartMenuDir", "StartupCommonDir", "StartupDir", "SW_DISABLE", "SW_ENABLE", "SW_HIDE", "SW_LOCK", "SW_MAXIMIZE",
    "SW_MINIMIZE", "SW_RESTORE", "SW_SHOW", "SW_SHOWDEFAULT", "SW_SHOWMAXIMIZED", "SW_SHOWMINIMIZED", "SW_SHOWMINNOACTIVE", "SW_SHOWNA",
    "SW_SHOWNOACTIVATE", "SW_SHOWNORMAL", "SW_UNLOCK", "SystemDir", "TAB", "TempDir", "TRAY_ID", "TrayIconFlashing", "TrayIconVisible", "UserName",
    "UserProfileDir", "WDAY", "WindowsDir", "WorkingDir", "YDAY", "YEAR",
)
FIRST_OPERATOR = 0x40
OPERATORS = (",", "=", ">", "<", "<>", ">=", "<=", "(", ")", "+", "-", "/", "*", "&", "[", "]", "==", "^", "+=", "-=", "/=", "*=", "&=", "?", ":")
#: Opcodes with a number (kind, its form and the field that holds it) and with a string.
NUMBERS = {0x00: ("KeywordId", "<i", "i"), 0x01: ("FunctionId", "<i", "i"), 0x05: ("U32", "<I", "u"), 0x10: ("U64", "<Q", "u"), 0x20: ("F64", "<d", "f")}
STRINGS = {0x30: "KeywordString", 0x31: "FunctionString", 0x32: "MacroString", 0x33: "Variable", 0x34: "BareString", 0x35: "Property", 0x36: "QuotedString", 0x37: "RawString"}
LINE_END = 0x7F


def float_text(value: float) -> str:
    """The shortest positional decimal that reads back as value, without exponent or `.0`."""
    if value != value:
        return "NaN"
    if value in (float("inf"), float("-inf")):
        return "inf" if value > 0 else "-inf"
    return np.format_float_positional(value, trim="-")


def _plain(raw: bytes) -> str:
    """The text of a string token's units, each of which is crossed with their number."""
    return (np.frombuffer(raw, "<u2") ^ np.uint16(len(raw) // 2)).astype("<u2").tobytes().decode("utf-16-le")


#: Words come again and again, so what short ones stand for, and how they are written, is kept.
_SHORT, _KEPT = 32, 1 << 14
_texts: dict[bytes, str] = {}
_tokens: dict[tuple[int, str], bytes] = {}


def _keep(kept: dict, key, value):
    if len(kept) >= _KEPT:
        kept.clear()
    kept[key] = value
    return value


def parse(data: bytes) -> tuple[int | None, list[tuple] | None, str | None]:
    """(line_count, tokens, None) or (None, None, reason); a token is (kind, text, i, u, f).

    Names are not looked up here: that is a join.
    """
    try:
        return *_parse(data), None
    except struct.error:
        return None, None, TRUNCATED
    except UnicodeDecodeError:
        return None, None, BAD_STRING
    except OverflowError:
        return None, None, BAD_STRING


def _parse(data: bytes) -> tuple[int, list[tuple]]:
    (lines,) = struct.unpack_from("<I", data, 0)
    out, at, done = [], 4, 0
    while done < lines:
        if at >= len(data):
            raise struct.error
        opcode = data[at]
        at += 1
        if opcode == LINE_END:
            done += 1
            out.append(("LineEnd", None, None, None, None))
        elif opcode in NUMBERS:
            kind, form, field = NUMBERS[opcode]
            (value,) = struct.unpack_from(form, data, at)
            at += struct.calcsize(form)
            out.append((kind, float_text(value) if field == "f" else None, *(value if field == f else None for f in "iuf")))
        elif opcode in STRINGS:
            (count,) = struct.unpack_from("<I", data, at)
            at += 4
            if count > 0xFFFF and at + 2 <= len(data):
                raise OverflowError
            if at + 2 * count > len(data):
                raise struct.error
            raw = data[at : at + 2 * count]
            at += 2 * count
            if count > _SHORT:
                text = _plain(raw)
            elif (text := _texts.get(raw)) is None:
                text = _keep(_texts, raw, _plain(raw))
            out.append((STRINGS[opcode], text, None, None, None))
        elif 0 <= opcode - FIRST_OPERATOR < len(OPERATORS):
            out.append(("Operator", OPERATORS[opcode - FIRST_OPERATOR], None, None, None))
        else:
            out.append(("UnknownOpcode", None, opcode, None, None))
    return lines, out


def string_token(opcode: int, text: str) -> bytes:
    if len(text) > _SHORT:
        return _token(opcode, text)
    return _tokens.get((opcode, text)) or _keep(_tokens, (opcode, text), _token(opcode, text))


def _token(opcode: int, text: str) -> bytes:
    units = np.frombuffer(text.encode("utf-16-le"), "<u2")
    return struct.pack("<BI", opcode, len(units)) + (units ^ np.uint16(len(units))).astype("<u2").tobytes()


def number_token(opcode: int, value: float) -> bytes:
    return struct.pack("<B", opcode) + struct.pack(NUMBERS[opcode][1], value)


def operator_token(text: str) -> bytes:
    return bytes([FIRST_OPERATOR + OPERATORS.index(text)])


def stream(lines: list[bytes]) -> bytes:
    return struct.pack("<I", len(lines)) + b"".join(line + bytes([LINE_END]) for line in lines)
